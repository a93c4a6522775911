"""URL rules, and decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; without ``://`` empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that fits, or null. A rule fits its host
    and all its subdomains where the path starts with the rule's path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))  # of equal rules, allow comes first
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def decoded(text: Column) -> Column:
    """Character references usual in urls replaced; that of the ampersand last, so that nothing is decoded twice."""
    for pattern, sign in ((r"(?i)&(?:#0*47|#x0*2f|sol);", "/"), (r"(?i)&(?:#0*58|#x0*3a|colon);", ":"), (r"(?i)&(?:#0*61|#x0*3d|equals);", "="), (r"(?i)&(?:#0*63|#x0*3f|quest);", "?"), (r"(?i)&(?:#0*35|#x0*23|num);", "#"), (r"(?i)&(?:#0*34|#x0*22|quot);", '"'), (r"(?i)&(?:#0*39|#x0*27|apos);", "'"), (r"(?i)&(?:#0*60|#x0*3c|lt);", "<"), (r"(?i)&(?:#0*62|#x0*3e|gt);", ">"), (r"(?i)&(?:#0*38|#x0*26|amp);", "&")):
        text = F.regexp_replace(text, pattern, sign)
    return text


def without_dots(path: Column) -> Column:
    """A path from ``/`` on without its ``.`` and ``..`` parts; one of these at the end leaves a ``/``."""
    parts = F.split(path, "/", -1)
    up = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x))),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.size(up) > 0, F.concat(F.lit("/"), F.array_join(up, "/"), ends)).otherwise(F.lit("/"))


def resolved(target: Column, base: Column) -> Column:
    """The url that a page at ``base`` means by ``target``: one with a scheme stands as it is; others take the
    base's scheme, host, directory or path, as far as they leave them out. A base without ``://`` resolves nothing."""
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path, asked = path_of(base), F.regexp_extract(base, r"(?s)^[^#]*", 0)
    mine, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (origin == "") | base.isNull(), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, without_dots(mine), rest))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#"), F.concat(asked, target))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, mine)), rest))
    )


#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"


def head_tags(html: Column) -> Column:
    """What follows the ``<`` of each ``link`` and ``meta`` tag up to the next ``<``, but for those in comments and in the
    content of ``RAW`` elements. Comments and those elements are taken out from left to right, to the page's end if they
    are not closed, so no part of a page is read again for another one."""
    unseen = rf"(?is)<!--(?:-?>|.*?(?:-->|\z))|<({RAW})(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
    pieces = F.split(F.regexp_replace(html, unseen, " "), "<", -1)
    return F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda piece: piece.rlike(r"^(?i:link|meta)[\s/]"))


def attribute(name: str) -> Column:
    """The value of the first attribute of that name, of a tag's ``pairs`` of a word and what follows it; null without one.
    Quotes around it go."""
    value = F.get(F.filter("pairs", lambda p: (F.lower(p["word"]) == name) & p["next"].startswith("=")), F.lit(0))["next"]
    bare = F.regexp_replace(value, r"(?s)^=\s*+", "")
    quoted = F.regexp_extract(bare, r"""(?s)^(["'])(.*)\1$""", 2)
    return F.when(F.substring(bare, 1, 1).isin('"', "'") & (F.length(bare) > 1) & bare.endswith(F.substring(bare, 1, 1)), quoted).otherwise(bare)


def links_in_pages(pages: DataFrame) -> DataFrame:
    """(source, target) of all canonical links and redirects by meta refresh of each page, decoded and resolved
    against the page's url. What looks like a tag in a comment or a script is none. A quote counts only behind an
    equals sign, and a ``>`` between quotes does not end a tag; a ``<`` there does."""
    likely = F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv")
    tags = pages.where(likely).select(F.col("url").alias("source"), F.explode(head_tags(F.col("html"))).alias("tag"))
    words = F.regexp_extract_all("tag", F.lit(r"""(?s)=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|>|[^\s=>]++"""), F.lit(0))
    cut = tags.select("source", words.alias("words")).withColumn("end", F.array_position("words", ">").cast("int"))
    cut = cut.withColumn("words", F.when(F.col("end") > 0, F.slice("words", F.lit(1), F.col("end") - 1)).otherwise(F.col("words"))).where("size(words) > 0")
    follow = F.concat(F.slice("words", F.lit(2), F.size("words")), F.array(F.lit("")))
    paired = cut.select("source", F.lower(F.col("words")[0]).alias("name"), F.zip_with("words", follow, lambda w, n: F.struct(w.alias("word"), n.alias("next"))).alias("pairs"))
    read = paired.select("source", "name", *[attribute(n).alias(n.replace("-", "_")) for n in ("rel", "href", "http-equiv", "content")])
    canonical = (F.col("name") == "link") & F.array_contains(F.split(F.lower(decoded(F.col("rel"))), r"\s+"), "canonical")
    refresh = (F.col("name") == "meta") & (F.lower(F.trim("http_equiv")) == "refresh")
    jump = F.regexp_extract(decoded(F.col("content")), r"(?is)\burl\s*=\s*[\"']?([^\"'\s]+)", 1)
    found = read.select("source", F.when(canonical, decoded(F.col("href"))).when(refresh, jump).alias("target"))
    trimmed = found.select("source", F.btrim("target", F.lit(" \t\n\x0c\r")).alias("target")).where("target <> ''")
    return trimmed.select("source", resolved(F.col("target"), F.col("source")).alias("target"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    A url takes the verdict of the longest rule that fits it. Others take the method's: urls joined by
    canonical links of the pages, meta refreshes and ``redirects`` (source, target) are aliases, and an alias
    of a url that a rule blocks is blocked, whatever chain of links leads there. A rule that allows a url
    holds for it even among blocked aliases; without a blocked alias the verdict is ``default``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and have no aliases beyond
    equal text or links that name a whole url; a null html has no links. Targets in pages are resolved against the
    page's url (``base`` elements are not read). Repeated urls are judged alike. Empty tables yield no rows.
    """
    edges = links_in_pages(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    edges = materialize(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).distinct(), "aliases")
    mine = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    mine = mine.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    rest = F.lit(default)
    if not edges.isEmpty():
        group = materialize(components(edges), "alias-groups")
        own = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
        blocked = materialize(group.where(own["verdict"] == "block").select("component").distinct(), "blocked-groups")
        hit = materialize(group.join(blocked, "component").select(F.col("node").alias("url"), F.lit(True).alias("by_alias")), "blocked-aliases")
        mine = mine.join(hit, "url", "left")
        rest = F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit(default))
    return mine.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), rest).alias("verdict"))
