"""URL filter: rules by host and path, and per-host trees of path templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitframe.llm.common import stored

#: (host, path, verdict); a rule holds for its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A segment stays literal with this many urls, whatever its siblings have.
LITERAL_ROWS = 3
#: Pseudo-counts that draw a node to its parent, and a host to all labels.
STRENGTH = 10.0
#: A template is rejected from this smoothed share of blocked labels on.
REJECT = 0.5


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, "^(?s).*?://(.*)$", 1), "/", 1)
    bare = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _share(b: Column, a: Column, prior: Column) -> Column:
    return (b + F.lit(STRENGTH) * prior) / (b + a + F.lit(STRENGTH))


#: Parts that a hot node's paths are dealt into where they are joined with what is known of the node.
SALTS = 8


def _with(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, which have ``path``, left joined with ``facts``, a row per key; one key's rows go to ``SALTS`` parts."""
    spread = facts.withColumn("_s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "_s"], "left").drop("_s")


def _shape(c: str) -> Column:
    """Digits as 9 and all else but dots and slashes as a."""
    return F.regexp_replace(F.regexp_replace(c, "[0-9]+", "9"), "[^0-9/.]+", "a")


def _merged(rows: DataFrame, literal: DataFrame) -> DataFrame:
    """``host, template, seg, group``: literal siblings that look alike share a group.

    A child is described by the shares of what follows it (the next segment
    where it has support among all siblings, else its shape; the shape of the
    rest; the label) and by its labels.  Siblings with the same majority label
    and commonest kind are pooled; one joins its pool when its Hellinger
    distances from both the pool's kinds and the pool's labels are no more than
    chance allows for its counts.  A group is named for its least member; a
    sibling without a match is left out.
    """
    node, child = ["host", "template"], ["host", "template", "seg"]
    label = F.when(F.col("blocked") > F.col("allowed"), "b").when(F.col("allowed") > 0, "a").otherwise("-")
    supported = rows.groupBy(*node, "next").agg(F.sum("n").alias("nn")).where(F.col("nn") >= LITERAL_ROWS).select(*node, "next", F.lit(True).alias("supported"))
    kind = F.concat_ws("|", F.when(F.col("supported"), F.col("next")).otherwise(_shape("next")), _shape("rest"), label)
    kinds = _with(rows, supported, [*node, "next"]).groupBy(*child, kind.alias("kind")).agg(F.sum("n").cast("double").alias("k")).join(literal.select(*child), child)
    kinds = stored(kinds, "kinds")
    most = kinds.groupBy(*child).agg(F.max(F.struct("k", "kind"))["kind"].alias("most"), F.sum("k").alias("bn"))
    pool = [*node, "sign", "most"]
    sized = literal.join(most, child).withColumn("sign", F.signum(F.col("b") - F.col("a")))
    totals = sized.groupBy(*pool).agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"), F.sum("bn").alias("pn"), F.count("*").alias("members")).where("members > 1")
    counted = stored(kinds.join(sized, child).join(totals, pool), "counted")
    pooled = counted.groupBy(*pool, "kind").agg(F.sum("k").alias("pk"))
    many = pooled.groupBy(*pool).agg(F.count("*").alias("kinds"))
    labelled, every = F.col("b") + F.col("a"), F.col("pb") + F.col("pa")
    same = F.when(labelled > 0, F.sqrt(F.col("b") / labelled * F.col("pb") / every) + F.sqrt(F.col("a") / labelled * F.col("pa") / every)).otherwise(1.0)
    close = (
        counted.join(pooled, [*pool, "kind"]).join(many, pool)
        .groupBy(*child, "sign", "most", "b", "a", "pb", "pa", "bn", "kinds").agg(F.sum(F.sqrt(F.col("k") / F.col("bn") * F.col("pk") / F.col("pn"))).alias("bc"))
        .where((1 - F.col("bc") <= 0.02 + 3 * (F.col("kinds") - 1) / (8 * F.col("bn"))) & (1 - same <= 0.02 + 3 / (8 * F.greatest(labelled, F.lit(1)))))
    )
    named = close.groupBy(*pool).agg(F.min("seg").alias("group"), F.count("*").alias("alike")).where("alike > 1").drop("alike")
    return close.select(*child, "sign", "most").join(named, pool).select(*child, "group")


def _literal(seg: str) -> Column:
    """A literal segment in a template; one that looks like a wildcard, a group or this mark has a backslash before it."""
    return F.concat(F.lit("/"), F.when(F.col(seg).rlike(r"^[*{\\]"), "\\").otherwise(""), F.col(seg))


def _tree(paths: DataFrame, everywhere: float) -> DataFrame:
    """``paths`` (host, path, n, blocked, allowed) with ``template``, ``purity`` and ``known``.

    Level by level, a node's segments with ``LITERAL_ROWS`` urls or more are
    literal, the others are its variable part ``*``; literal siblings that
    look alike become one node ``{least of them}``.  The purity of a node is
    drawn to its parent's.  A node with fewer urls than a literal segment
    needs, or with one path, is not split: what follows is ``**``.  The tree
    is as deep as the paths are.
    """
    segs = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", "^/", ""), "/"))
    hosts = paths.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("allowed").alias("ha"), F.sum("n").alias("t"), F.count("*").alias("paths"))
    hosts = hosts.select("host", _share(F.col("hb"), F.col("ha"), F.lit(everywhere)).alias("purity"), (F.col("hb") + F.col("ha") > 0).alias("known"), "t", "paths")
    live = stored(_with(paths.withColumn("segs", segs).withColumn("template", F.lit("")), hosts, ["host"]), "level")
    columns = ["host", "path", "n", "blocked", "allowed", "segs", "known"]
    done, level = None, 0
    while True:
        left = F.size("segs") - level
        stop = (F.col("t") < LITERAL_ROWS) | (F.col("paths") == 1)
        rows = live.select(
            *columns, "template", "purity", "t", left.alias("left"), F.get("segs", F.lit(level)).alias("seg"), ((left <= 0) | stop).alias("ended"),
            F.coalesce(F.get("segs", F.lit(level + 1)), F.lit("")).alias("next"), F.array_join(F.slice("segs", level + 3, F.greatest(left - 2, F.lit(0))), "/").alias("rest"),
        )
        going = rows.where("not ended")
        literal = going.groupBy("host", "template", "seg").agg(F.sum("n").alias("c"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).where(F.col("c") >= LITERAL_ROWS)
        literal = stored(literal, "literal")
        steps = literal.select("host", "template", "seg", F.lit(True).alias("literal"))
        siblings = literal.groupBy("host", "template").count().where("count > 1").take(1)
        steps = steps.join(_merged(going, literal), ["host", "template", "seg"], "left") if siblings else steps.withColumn("group", F.lit(None).cast("string"))
        whole = F.when(F.col("left") <= 0, "").when(F.col("left") > 1, "/**").when(F.col("t") < LITERAL_ROWS, "/*").otherwise(_literal("seg"))
        split = F.when(F.col("group").isNotNull(), F.concat(F.lit("/{"), "group", F.lit("}"))).when(F.col("literal"), _literal("seg")).otherwise("/*")
        rows = _with(rows, steps, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.when(F.col("ended"), whole).otherwise(split)))
        rows = stored(rows.select(*columns, "template", "purity", "ended"), "rows")
        sums = rows.groupBy("host", "template", "ended").agg(
            _share(F.sum("blocked"), F.sum("allowed"), F.first("purity")).alias("purity"), F.sum("n").alias("t"), F.count("*").alias("paths")
        )
        rows = stored(_with(rows.drop("purity"), sums, ["host", "template", "ended"]), "level")
        ready = rows.where("ended").select("host", "path", "template", "purity", "known")
        done = ready if done is None else done.unionByName(ready)
        live, level = rows.where("not ended").drop("ended"), level + 1
        if not live.take(1):
            return done


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """A verdict on every url.

    ``pages`` has ``page_id`` and ``url``; ``labels``, if given, ``page_id``
    and ``label`` (``block`` or ``allow``), else the rules' own verdicts label
    the urls that they fit.  Returns ``page_id, host, path, rule, verdict,
    template, purity``, a row for each row.

    Distinct paths are counted first, so a host or url with a third of all
    rows enters the tree as counts.  Urls without a rule have the verdict of
    their template: ``block`` where the smoothed share of blocked labels
    reaches ``REJECT``; on a host without labels nothing is blocked.  A null
    url, or one without ``://``, has the host and path ''.  Null and repeated
    page_ids are rows like others; ties in purity cannot arise, as a share of
    ``REJECT`` blocks; an empty table gives an empty one; other columns are
    ignored; urls of any length are read whole.
    """
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), ruled.alias("ruled"))
    if labels is None:
        known = urls.withColumn("label", F.col("ruled"))
    else:
        one = labels.where("page_id is not null").groupBy("page_id").agg(F.min("label").alias("label"))
        known = urls.join(one, "page_id", "left")
    paths = known.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("blocked"), F.count_if(F.col("label") == "allow").alias("allowed")
    )
    paths = stored(paths, "paths")
    blocked, allowed = paths.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    everywhere = blocked / (blocked + allowed) if blocked + allowed else 0.0
    judged = _tree(paths, everywhere)
    out = urls.join(judged, ["host", "path"], "left")
    method = F.when(F.col("known") & (F.col("purity") >= REJECT), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
