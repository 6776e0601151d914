"""URL verdicts from host and path rules and, where none fits, from a path-template tree for each host.

The tree: level by level, the variable segments of a host's paths become wildcards. A segment with digits is variable
unless it holds a good share of its node's pages; segments without digits are variable where a node has many with few
pages each. Branches below a host whose children's counts are alike, by a chi-square test, are merged, so that their
labels count together; those whose labels disagree with the merged ones stay apart. A template is rejected if its
smoothed share of blocked labels reaches a threshold. Labels are the pages that a rule has decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ascii_lower, materialise

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path; the longest wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_RULES = 1000
#: Levels of the tree; what lies deeper keeps its place in the template, generalised by form alone.
DEPTH = 4
#: A segment with digits stays as it is if it has so many pages and at least so large a share of its node's; else its digits go.
KEEP_PAGES, KEEP_SHARE = 5, 4
#: The children of a node that hold no digits become one wildcard from so many with so few pages each on average.
MANY_CHILDREN, FEW_PAGES = 20, 5
#: Branches are merged within so many standard deviations, of their children's counts and of their labels.
DEVIATIONS = 3
SMOOTHING, REJECT_AT = 2.0, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` with A-Z lowered, path up to `?`, `#` or the end; both empty for null or without `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, block first among equals; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most, since each is an expression of the plan")
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def form(segment: Column) -> Column:
    """A segment with its variable parts as `*`: long hexadecimal runs with a digit, and runs of digits."""
    return F.when(segment.rlike(r"\A[0-9a-f]{8,}\z") & segment.rlike("[0-9]"), "*").otherwise(F.regexp_replace(segment, "[0-9]+", "*"))


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), F.lower)


def _level(tree: DataFrame, level: int) -> DataFrame:
    """Adds the segment at `level`, as it is, by its form or as a wildcard, to each path's `done`."""
    here = F.get("segs", F.lit(level))
    child = tree.where(here.isNotNull()).groupBy("host", "done", here.alias("here")).agg(F.sum("n").alias("n"))
    plain = form(F.col("here")) == F.col("here")
    node = child.groupBy("host", "done").agg(F.sum("n").alias("pages"), F.count_if(plain).alias("plain"), F.sum(F.when(plain, F.col("n"))).alias("plain_pages"))
    # Nodes are written, so that joins with them read plain tables: small ones are broadcast, a hot node's paths are split.
    node = materialise(node, f"url-nodes-{level}")
    kept = child.where(F.col("n") >= KEEP_PAGES).join(node, ["host", "done"]).where(F.col("n") * KEEP_SHARE >= F.col("pages"))
    kept = materialise(kept.select("host", "done", "here", F.lit(True).alias("kept")), f"url-kept-{level}")
    wild = node.where((F.col("plain") >= MANY_CHILDREN) & (F.col("plain_pages") < FEW_PAGES * F.col("plain"))).select("host", "done", F.lit(True).alias("wild"))
    tree = tree.withColumn("here", here).join(kept, ["host", "done", "here"], "left").join(wild, ["host", "done"], "left")
    name = F.when(F.col("kept"), F.col("here")).when(F.col("wild") & (form(F.col("here")) == F.col("here")), "*").otherwise(form(F.col("here")))
    return tree.select("host", "segs", "n", "labelled", "bad", F.when(F.col("here").isNull(), F.col("done")).otherwise(F.concat("done", F.array(name))).alias("done"))


def branch_priors(template: DataFrame) -> DataFrame:
    """template: host, branch, rest, n, labelled, bad. Returns host, branch, prior: the smoothed purity of what a branch is merged with.

    Branches of a host are merged if their children's counts are those of the whole host but for chance (chi-square
    within DEVIATIONS of its mean), and those with labels only if their labels too are the merged ones' but for
    chance. A branch without labels thus counts with the labels of those that look like it. What is left open falls
    back to the host, then to its parent domain, then to a half.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    branch = template.groupBy("host", "branch").agg(*sums)
    rests = template.groupBy("host", "rest").agg(F.sum("n").alias("m"))
    host = rests.groupBy("host").agg(F.sum("m").alias("all"), F.count(F.lit(1)).alias("kinds"))
    unlike = template.join(rests, ["host", "rest"]).join(host, "host").groupBy("host", "branch").agg(F.sum(F.col("n") * F.col("n") * F.col("all") / F.col("m")).alias("s"))
    free = F.col("kinds") - 1
    alike = (F.col("s") / F.col("n") - F.col("n") <= free + DEVIATIONS * F.sqrt(2 * free) + 1e-6).alias("alike")
    tested = branch.join(unlike, ["host", "branch"]).join(host, "host").select("host", "branch", "labelled", "bad", alike)
    rate = tested.where("alike").groupBy("host").agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.5)).alias("rate"))
    off = F.abs(F.col("bad") - F.col("labelled") * F.col("rate"))
    within = off <= DEVIATIONS * F.sqrt(F.col("labelled") * F.col("rate") * (1 - F.col("rate"))) + 0.5
    agreed = tested.join(rate, "host", "left").select("host", "branch", "labelled", "bad", (F.col("alike") & within).alias("pooled"))
    pool = agreed.where("pooled").groupBy("host").agg(F.sum("labelled").alias("pool_labelled"), F.sum("bad").alias("pool_bad"))
    domain = F.when(F.col("host").rlike(r"\A[0-9.]*\z"), F.col("host")).otherwise(F.regexp_extract("host", r"([^.]*\.?[^.]*)\z", 1))
    hosts = branch.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad")).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(((F.sum("host_bad") + SMOOTHING / 2) / (F.sum("host_labelled") + SMOOTHING)).alias("domain_prior"))
    hosts = hosts.join(domains, "domain").select("host", ((F.col("host_bad") + SMOOTHING * F.col("domain_prior")) / (F.col("host_labelled") + SMOOTHING)).alias("host_prior"))
    bad, labelled = (F.when(F.col("pooled"), F.col("pool_" + c)).otherwise(F.col(c)) for c in ("bad", "labelled"))
    return agreed.join(hosts, "host").join(pool, "host", "left").select("host", "branch", ((bad + SMOOTHING * F.col("host_prior")) / (labelled + SMOOTHING)).alias("prior"))


def template_tree(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """pages: host, segs, blocked (boolean; null if unlabelled). Returns host, segs, template, purity.

    Only counts of (host, segs) are shuffled after a partial aggregation; the tables of nodes, branches and hosts are
    smaller still, and no window or list gathers a host's pages.
    """
    tree = (
        pages.groupBy("host", "segs")
        .agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.count_if("blocked").alias("bad"))
        .withColumn("done", F.array().cast("array<string>"))
    )
    for level in range(depth):
        tree = _level(materialise(tree, f"url-tree-{level}"), level)
    deeper = F.transform(F.slice("segs", depth + 1, F.greatest(F.size("segs"), F.lit(1))), form)
    tree = materialise(tree.withColumn("done", F.concat("done", deeper)), "url-tree")
    rest = F.array_join(F.slice("done", 2, F.greatest(F.size("done"), F.lit(1))), "/")
    template = tree.groupBy("host", "done").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    template = materialise(template.withColumns({"branch": F.coalesce(F.get("done", F.lit(0)), F.lit("")), "rest": rest}), "url-templates")
    purity = (F.col("bad") + SMOOTHING * F.col("prior")) / (F.col("labelled") + SMOOTHING)
    scored = materialise(template.join(branch_priors(template), ["host", "branch"]).select("host", "done", purity.alias("purity")), "url-purity")
    return tree.join(scored, ["host", "done"]).select("host", "segs", F.concat(F.lit("/"), F.array_join("done", "/")).alias("template"), F.round("purity", 6).alias("purity"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages (page_id, url; other columns are not read).

    A rule's verdict stands; elsewhere a template whose purity reaches REJECT_AT is blocked and any other allowed.
    Labels are the pages that a rule decides. A null url, or one without `://`, has empty host and path and is judged
    like any other. Where neither a host nor its parent domain has labels, purity is 0.5. Rows that repeat stay. An
    empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    tree = template_tree(urls.select("host", "segs", (F.col("hit.verdict") == "block").alias("blocked")), depth)
    method = F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow")
    return urls.join(tree, ["host", "segs"]).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "template", "purity")
