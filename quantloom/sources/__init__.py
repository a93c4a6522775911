"""Where tables come from: canonical views of the star schema, and price files."""
