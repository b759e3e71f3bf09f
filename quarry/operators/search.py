"""Batch search: a table of queries against a table of parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..staging import stage_observed, stage_table
from .vectors import Tiles

# Match tiers, strongest first, with their scores, and their names in result documents.
TIERS = {"exact": 4, "trig": 3, "fts": 2, "semantic": 1, "nearest": 0}
MATCH_TYPES = {"exact": "exact", "trig": "trigram", "fts": "fulltext", "semantic": "semantic", "nearest": "nearest"}
SORTS = ("relevance", "stock", "price")
MOST_RESULTS, TERM_CHARS = 200, 128
#: Shares that a word's or family's parts are ranked in before the best of all shares are.
SHARES = 32
# Words that full-text search passes over.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# How far a parameter may be from the value asked for.
BRACKETS = {"resistance": 0.01, "frequency_max": 0.01, "capacitance": 0.05, "inductance": 0.05, "current_max": 0.05, "power": 0.05, "voltage_max": 0.02, "voltage_min": 0.02}
#: Letters of the pieces that numbers are indexed by: for needles of three or more, and of six or more.
GRAM, LONG = 3, 6
#: Buckets of a parameter's values.
BUCKETS = 64
#: Rows of keys that may be sent to every task.
FEW = 200_000


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def terms(c: Column) -> Column:
    """The stems of the words that full-text search looks for."""
    return F.array_distinct(F.transform(F.array_except(words(c), F.array(*map(F.lit, STOP_WORDS))), exprs.stem))


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int, salt: str = "xid") -> DataFrame:
    """The first ``k`` rows of each key with ``n``, their place. The first of every share of a key's
    rows are found before those of the key, so a key with very many rows is no single task."""
    share = F.pmod(F.xxhash64(salt), F.lit(SHARES)).alias("__share")
    some = rows.withColumn("__share", share).withColumn("n", F.row_number().over(Window.partitionBy(*keys, "__share").orderBy(*order))).where(F.col("n") <= k)
    return some.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= k).drop("__share")


def exact(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, xid): the normalised query is the part's number."""
    q = queries.select("query_id", exprs.normalize(F.col("raw_query")).alias("mpn_norm")).where("mpn_norm != ''")
    return q.join(parts.select("mpn_norm", "xid"), "mpn_norm").select("query_id", "xid")


def _few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` at most, to be sent to every task if they are few; more are joined by a shuffle."""
    return F.broadcast(rows) if n <= FEW else rows


def _pieces(text: Column, sizes) -> Column:
    """array<struct(gram, at)>: every piece of a text of the given lengths, with its place, from 0."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.struct(F.substring(text, i, F.lit(n)).alias("gram"), (i - 1).alias("at")))
    return F.concat(*[F.when(F.length(text) >= n, cut(n)).otherwise(F.array().cast("array<struct<gram:string,at:int>>")) for n in sizes])


def containing(needles: DataFrame, parts: DataFrame, best: int | None = None, package: bool = False) -> DataFrame:
    """(needle, xid) of the parts whose number contains each ``needle``, a table of distinct ones; with
    ``best``, of the first so many in order of relevance; with ``package``, rows are
    (needle, package, xid) and a package that is not null must be the part's.

    A positional index of 3-grams, and of 6-grams for needles that have such, read only where needles have grams. One pass counts the
    parts that hold each gram that any needle has; each needle is then looked up by its two
    rarest grams: the postings of the rarest tell where the needle would start, a second
    one must be at its own place from there, and what they agree on must be the needle's first
    occurrence, so a part is met once. Needles of one or two letters are pieces themselves.
    Needles that are few go to the parts; no posting is shuffled then, and each task keeps
    ``best`` parts a needle.
    """
    own = ["needle", *(["package"] if package else [])]
    needles = needles.select(*own).where("needle != ''")
    columns = ["xid", "mpn_norm", *(["stock", "is_basic"] if best is not None else []), *([F.col("package").alias("__of")] if package else [])]
    number = F.col("mpn_norm")
    long = F.length("needle") >= LONG
    pieces = F.when(long, _pieces(F.col("needle"), [LONG])).otherwise(_pieces(F.col("needle"), [GRAM]))
    looked = needles.select("needle", F.explode_outer(F.when(F.length("needle") >= GRAM, pieces)).alias("g")).select("needle", F.coalesce("g.gram", "needle").alias("gram"), F.coalesce("g.at", F.lit(0)).alias("at"))
    looked, seen = stage_observed(looked.distinct(), "needle_grams", one=F.count_if(F.length("gram") == 1), two=F.count_if(F.length("gram") == 2), three=F.count_if(F.length("gram") == GRAM), six=F.count_if(F.length("gram") == LONG))
    sizes = [n for n, k in ((1, "one"), (2, "two"), (GRAM, "three"), (LONG, "six")) if seen[k]] or [GRAM]
    held = parts.select(F.explode(F.array_distinct(F.transform(_pieces(number, sizes), lambda g: g["gram"]))).alias("gram"))
    held = held.join(_few(looked.select("gram").distinct(), seen["rows"]), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rare = looked.join(held, "gram", "left").groupBy("needle").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at"))).alias("g"))  # the grams of one needle
    second = F.coalesce(F.try_element_at("g", F.lit(2)), F.element_at("g", 1))
    probes = rare.where(F.element_at("g", 1)["n"] > 0).select("needle", F.element_at("g", 1)["gram"].alias("gram"), F.element_at("g", 1)["at"].alias("first_at"), second["gram"].alias("other"), second["at"].alias("other_at"))
    if package:
        probes = probes.join(needles, "needle")
    probes, n = stage_observed(probes, "probes")
    postings = parts.select(*columns, F.explode(_pieces(number, sizes)).alias("g")).select("*", "g.gram", "g.at").drop("g")
    start = F.col("at") - F.col("first_at") + 1
    agree = (F.substring(number, start + F.col("other_at"), F.length("other")) == F.col("other")) & (F.expr("instr(mpn_norm, needle)") == start)  # where it is first: once a part
    met = postings.join(_few(probes, n["rows"]), "gram").where((start >= 1) & agree).drop("gram", "at", "first_at", "other", "other_at")
    if package:
        met = met.where(F.col("package").isNull() | (F.col("package") == F.col("__of"))).withColumn("package", F.coalesce("package", F.lit("")))
    return (met if best is None else top(met, own, relevance(), best)).select(*own, "xid")


def substring(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, xid): the part's number contains the normalised query. Equal queries are looked up once."""
    q = queries.select("query_id", exprs.normalize(F.col("raw_query")).alias("needle"))
    return q.join(containing(q.select("needle").distinct(), parts), "needle").select("query_id", "xid").distinct()


def full_text(queries: DataFrame, parts: DataFrame, best: int | None = None) -> DataFrame:
    """(query_id, xid): any word of the query is in the description, in any of its forms (see ``exprs.stem``).

    With ``best``, only that many first parts of each word are held against the queries: all
    that a tier of ``best`` parts can need, as their order does not depend on the query.
    """
    q = queries.select("query_id", F.explode(terms(F.col("raw_query"))).alias("word"))
    columns = ["xid"] if best is None else ["xid", "mpn_norm", "stock", "is_basic"]
    p = parts.select(*columns, F.explode(terms(F.col("description"))).alias("word"))
    if best is not None:
        p = top(p.join(q.select("word").distinct(), "word", "left_semi"), ["word"], relevance(), best)
    return q.join(p, "word").select("query_id", "xid").distinct()


def full_text_counts(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """(query_id, hits, first_xid): how many parts ``full_text`` finds for each query that finds any, and the least.

    Queries with the same words are answered once, and parts with the same words are counted
    once for all of them, so that no row is made for a query and a part.
    """
    q = queries.select("query_id", F.array_sort(terms(F.col("raw_query"))).alias("asked")).where(F.size("asked") > 0)
    q, n = stage_observed(q.distinct(), "asked_words")
    p = parts.select("xid", terms(F.col("description")).alias("found")).groupBy("xid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))  # a part's rows
    p = stage_table(p.groupBy("found").agg(F.count("*").alias("hits"), F.min("xid").alias("first_xid")).withColumn("id", F.monotonically_increasing_id()), "found_words")
    words_ = stage_table(q.select("asked").distinct().select("asked", F.explode("asked").alias("word")), "words")
    met = words_.join(p.select("id", "hits", "first_xid", F.explode("found").alias("word")), "word").select("asked", "id", "hits", "first_xid").distinct()
    met = met.groupBy("asked").agg(F.sum("hits").alias("hits"), F.min("first_xid").alias("first_xid"))
    return met.join(_few(q, n["rows"]), "asked").select("query_id", "hits", "first_xid")


def relevance() -> list[Column]:
    """Order of parts within a tier: in stock, basic, part number, part."""
    return [(F.coalesce("stock", F.lit(0)) > 0).desc(), F.desc("is_basic"), F.asc("mpn_norm"), F.asc("xid")]


def check(sort: str = "relevance", terms_: tuple[str | None, ...] = (), min_stock: int | None = None, max_price: float | None = None) -> None:
    """Raises ValueError for arguments that no search takes."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {sorted(SORTS)}")
    for t in terms_:
        if t is not None and not (t.strip() and len(t) <= TERM_CHARS):
            raise ValueError(f"a filter must be a text of 1 to {TERM_CHARS} characters")
    if min_stock is not None and (isinstance(min_stock, bool) or not isinstance(min_stock, int) or min_stock < 0):
        raise ValueError("the least stock must be a whole number, 0 or more")
    if max_price is not None and not (math.isfinite(max_price) and max_price >= 0):
        raise ValueError("the highest price must be a finite number, 0 or more")


def clamp(limit: int) -> int:
    return max(1, min(limit, MOST_RESULTS))


def filtered(parts: DataFrame, *, package: str | None = None, manufacturer: str | None = None, category: str | None = None, min_stock: int | None = None, is_basic: bool | None = None, max_price: float | None = None, datasheets: DataFrame | None = None, has: tuple[str, ...] = (), lacks: tuple[str, ...] = ()) -> DataFrame:
    """Parts that pass every filter given: equal package, all terms of maker and category, stock and
    price bounds that nulls fail, basic or not, an edge (xid, url) to a datasheet, and columns
    that must or must not be null."""
    check("relevance", (package, manufacturer, category), min_stock, max_price)
    tests = [
        package is not None and F.col("package") == package,
        manufacturer is not None and all_terms(F.col("manufacturer"), F.lit(manufacturer)),
        category is not None and all_terms(F.col("category"), F.lit(category)),
        min_stock is not None and F.col("stock") >= min_stock,
        is_basic is not None and F.col("is_basic") == is_basic,
        max_price is not None and F.col("price_usd") <= max_price,
        *[F.col(c).isNotNull() for c in has],
        *[F.col(c).isNull() for c in lacks],
    ]
    for t in tests:
        if t is not False:
            parts = parts.where(t)
    return parts if datasheets is None else parts.join(datasheets.where("url IS NOT NULL").select("xid").distinct(), "xid", "left_semi")


def ranked(hits: DataFrame, parts: DataFrame, sort: str = "relevance", limit: int = 50) -> DataFrame:
    """Hits (query_id, xid, tier): each tier cut to ``limit`` in order of relevance, every part in its
    strongest tier, then placed by ``sort``: relevance, stock or price."""
    check(sort)
    score = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    rows = hits.distinct().join(parts.select("xid", "mpn_norm", "stock", "is_basic", "price_usd"), "xid")
    rows = top(rows, ["query_id", "tier"], relevance(), clamp(limit)).withColumn("tier_score", score[F.col("tier")])
    best = F.row_number().over(Window.partitionBy("query_id", "xid").orderBy(F.desc("tier_score")))
    rows = rows.withColumn("n", best).where("n = 1").drop("n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(sort))))


def _order(sort: str) -> list[Column]:
    stocked = F.greatest(F.coalesce("stock", F.lit(0)), F.lit(0))
    return {"relevance": [F.desc("tier_score"), *relevance()], "stock": [stocked.desc(), F.asc("mpn_norm"), F.asc("xid")], "price": [F.asc_nulls_last("price_usd"), F.asc("mpn_norm"), F.asc("xid")]}[sort]


def _listed(rows: DataFrame, asked: DataFrame, n: int, limit: int, of: list[str]) -> DataFrame:
    """(query_id, xid, tier, ...) of ``asked`` (query_id, tier, word, package, *of, ...), ``n`` rows at most: the best
    ``limit`` of ``rows`` (xid, package, found, *of, ...) for each word and package. The order of parts does not
    depend on the query, so queries that ask for one thing share its list. An empty word is any."""
    key = lambda word, package: F.struct(word.alias("word"), package.alias("package"), *of)
    asked = asked.where("word != '' OR package IS NOT NULL OR tier = 'all'").withColumn("key", key(F.col("word"), F.coalesce("package", F.lit("")))).drop("word", "package", *of)
    every = F.array_append("found", "")
    plain = F.transform(every, lambda w: key(w, F.lit("")))
    of_package = F.transform(F.when(F.col("package") != "", every).otherwise(F.array().cast("array<string>")), lambda w: key(w, F.col("package")))
    lists = rows.select("xid", "mpn_norm", "stock", "is_basic", F.explode(F.concat(plain, of_package)).alias("key"))
    lists = top(lists.join(_few(asked.select("key").distinct(), n), "key", "left_semi"), ["key"], relevance(), limit).select("key", "xid")
    return asked.join(lists, "key").drop("key")


def _tiers(q: DataFrame, asked_for: int, of: DataFrame, bound: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """(query_id, xid, tier, relaxed): hits of ``asked_for`` read queries (query_id, words, package, quantities), no tier
    with fewer than its first ``limit``.

    Every query is looked up by its words: numbers by equality and by 3-grams, words and
    packages in lists of the best ``limit`` parts of each, which is all that a tier keeps. For a
    query with quantities such hits are ``relaxed``; its others are looked up alike among the
    parts that meet its request (``of``: query_id, request; ``bound``: request, xid), once for all
    queries with that request.
    """
    p = parts.select("xid", "mpn_norm", "package", "stock", "is_basic", terms(F.col("description")).alias("found"))
    joined, none, numeric = F.array_join("words", " "), F.size("words") == 0, F.size("quantities") > 0
    q = q.withColumn("needle", exprs.normalize(joined)).withColumn("asked", terms(joined))
    named, blank = F.col("needle") != "", F.coalesce("package", F.lit("")).alias("package")
    texts = q.where(named).select("query_id", "needle", blank, numeric.alias("relaxed"))
    needles = q.where(named).select("needle", "package").distinct()

    equal = needles.withColumnRenamed("package", "wanted").join(p, F.col("needle") == F.col("mpn_norm")).where(F.col("wanted").isNull() | (F.col("wanted") == F.col("package")))
    equal = top(equal.withColumn("package", F.coalesce("wanted", F.lit(""))), ["needle", "package"], relevance(), limit).select("needle", "package", "xid", F.lit("exact").alias("tier"))
    within = containing(needles, parts, limit, package=True).withColumn("tier", F.lit("trig"))
    out = texts.join(equal.unionByName(within), ["needle", "package"]).select("query_id", "xid", "tier", "relaxed")

    most = asked_for * exprs.QUERY_TOKENS
    asked = q.select("query_id", F.when(none, "exact").otherwise("fts").alias("tier"), F.explode(F.when(none, F.array(F.lit(""))).otherwise(F.col("asked"))).alias("word"), "package", numeric.alias("relaxed"))
    out = out.unionByName(_listed(p, asked, most, limit, []).select("query_id", "xid", "tier", "relaxed"))

    have = stage_table(bound.join(p, "xid"), "bound_parts")
    q = q.join(of, "query_id")
    asked = q.select("query_id", F.when(none, "all").otherwise("fts").alias("tier"), F.explode(F.when(none, F.array(F.lit(""))).otherwise(F.col("asked"))).alias("word"), "package", "request")
    met = _listed(have, asked, most, limit, ["request"]).withColumn("tier", F.when(F.col("tier") == "all", "exact").otherwise(F.col("tier")))
    out = out.unionByName(met.select("query_id", "xid", "tier", F.lit(False).alias("relaxed")))
    keys = ["request", "needle", "package"]
    needles = q.where(named).select("request", "needle", blank).distinct()
    hit = have.withColumnRenamed("package", "__of").join(_few(needles, asked_for), "request").where((F.col("package") == "") | (F.col("package") == F.col("__of"))).where(F.contains("mpn_norm", "needle"))
    tiers = F.when(F.col("needle") == F.col("mpn_norm"), F.array(F.lit("exact"), F.lit("trig"))).otherwise(F.array(F.lit("trig")))
    hit = top(hit.withColumn("tier", F.explode(tiers)), [*keys, "tier"], relevance(), limit).select(*keys, "tier", "xid")
    texts = q.where(named).select("query_id", "request", "needle", blank)
    return out.unionByName(texts.join(hit, keys).select("query_id", "xid", "tier", F.lit(False).alias("relaxed"))).distinct()


def lexical(queries: DataFrame, parts: DataFrame, values: DataFrame, *, sort: str = "relevance", limit: int = 50, **filters) -> DataFrame:
    """The search verb: texts (query_id, raw_query) answered from ``parts`` and their parameters
    ``values`` (xid, parameter, value).

    A text is read into quantities, a package and words. Parts that pass ``filters`` (see
    ``filtered``) and the query's own quantities and package are found by number, part of a
    number and words; without words there is one tier, exact. Where a query has quantities
    and finds nothing, what it finds without them is placed by distance. Blank queries find
    nothing. Returns query_id, rank, xid, tier, tier_score, nearest_match and distance, beside
    the columns that order results. Queries that read alike are answered once. Parts that pass,
    the read queries and the hits are written down, as the plan names them many times.
    """
    check(sort)
    limit = clamp(limit)
    parts = stage_table(filtered(parts, **filters).select("xid", "mpn_norm", "description", "package", "stock", "is_basic", "price_usd"), "eligible_parts")
    read = queries.select("query_id", exprs.parse_query(F.col("raw_query")).alias("p"))
    read = read.where((F.size("p.quantities") > 0) | F.col("p.package").isNotNull() | (F.size("p.words") > 0))
    read, asked = stage_observed(read.distinct(), "read_queries")
    q, n = stage_observed(read.select("p").distinct().select(F.monotonically_increasing_id().alias("id"), "p"), "different_queries")
    of = stage_table(read.join(q, "p").select("query_id", "id"), "answers")
    found = _answered(q.select(F.col("id").alias("query_id"), "p.*"), n["rows"], parts, values, sort, limit)
    return found.withColumnRenamed("query_id", "id").join(_few(of, asked["rows"]), "id").select("query_id", *found.columns[1:])


def _answered(q: DataFrame, n: int, parts: DataFrame, values: DataFrame, sort: str, limit: int) -> DataFrame:
    """``lexical`` for ``n`` read queries (query_id, quantities, package, words) of parts that pass."""
    targets = q.select("query_id", F.explode("quantities").alias("t")).select("query_id", "t.parameter", F.col("t.value").alias("target")).distinct()
    of, _, met = matched(targets, values.join(parts.select("xid"), "xid", "left_semi"))
    found = stage_table(_tiers(q, n, of, met, parts, limit), "hits")
    hard = stage_table(ranked(found.where("NOT relaxed").drop("relaxed"), parts, sort, limit), "direct_results")

    relaxed = ranked(found.where("relaxed").drop("relaxed").join(hard.select("query_id").distinct(), "query_id", "left_anti"), parts, "relevance", limit).select("query_id", "xid")
    near = nearest(targets, relaxed, hard.select("query_id", "xid"), values, 3 * limit, parts)
    shown = parts.select("xid", "mpn_norm", "stock", "is_basic", "price_usd")
    near = near.join(shown, "xid").select("query_id", "rank", "xid", F.lit("nearest").alias("tier"), F.lit(0).alias("tier_score"), F.lit(True).alias("nearest_match"), "distance", "mpn_norm", "stock", "is_basic", "price_usd")
    return hard.select("query_id", "rank", "xid", "tier", "tier_score", F.lit(False).alias("nearest_match"), F.lit(None).cast("double").alias("distance"), "mpn_norm", "stock", "is_basic", "price_usd").unionByName(near)


def _cuts(values: DataFrame) -> DataFrame:
    """(parameter, cuts): quantiles that part each parameter's values into ``BUCKETS`` buckets; a value that
    many parts have is several quantiles, which tell how many."""
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    return values.groupBy("parameter").agg(F.array_sort(F.percentile_approx("value", shares, 1000)).alias("cuts"))


def parametric(targets: DataFrame, values: DataFrame) -> DataFrame:
    """(query_id, xid) where every target (query_id, parameter, target) of a query has a value
    (xid, parameter, value) within its bracket; parameters without a bracket must be equal.
    Queries with the same targets are answered once (see ``matched``)."""
    asked, n, met = matched(targets, values)
    return met.join(_few(asked, n), "request").select("query_id", "xid")


def matched(targets: DataFrame, values: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Which request each query (query_id, request) has, how many such rows there are, and the parts (request, xid)
    that meet each request: every target of it, as ``parametric`` says.

    A request is a set of targets, a profile a set of values that a part has; both may be
    had by very many. Distinct requests meet distinct profiles in a range join by buckets:
    quantiles of each parameter bound its buckets, so values that crowd together are parted,
    whatever their sign or size. A bracket spans the buckets from that of its low end to that
    of its high end. The quantiles in a bracket tell which target of a request is met least;
    only that one is joined by bucket, and the profile is tested for the others where it is
    met. Brackets that are few go to the values. Many are joined by a shuffle, in which a
    bucket that stays large, as very many values are equal, is dealt into parts of even size,
    and brackets on it go to each part. Nulls and NaN are within no bracket.
    """
    table = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])
    asked = targets.where("parameter IS NOT NULL AND target IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("parameter", "target"))).alias("wanted"))
    asked, n = stage_observed(asked, "asked_targets")
    requests = stage_table(asked.select("wanted").distinct().withColumn("request", F.monotonically_increasing_id()), "requests")
    held = values.where("xid IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").groupBy("xid").agg(F.array_sort(F.collect_set(F.struct("parameter", "value"))).alias("held"))
    held = stage_table(held, "held_values")
    profiles = stage_table(held.select("held").distinct().withColumn("profile", F.monotonically_increasing_id()), "profiles")

    v = profiles.select(F.col("profile").alias("xid"), "held", F.posexplode("held").alias("at", "h")).select("xid", "held", "at", "h.parameter", "h.value")
    cuts = stage_table(_cuts(v), "parameter_cuts")
    bucket = lambda c: F.size(F.filter("cuts", lambda x: x <= c))
    v = v.join(F.broadcast(cuts), "parameter").select("xid", "held", "at", "parameter", "value", bucket(F.col("value")).alias("bucket"))  # a row a parameter

    def ends(t: Column) -> Column:
        f = F.coalesce(F.try_element_at(table, t["parameter"]), F.lit(0.0))
        both = t["target"] * (1 - f), t["target"] * (1 + f)
        return F.struct(t["parameter"].alias("parameter"), F.least(*both).alias("low"), F.greatest(*both).alias("high"))

    q = requests.select("request", F.transform("wanted", ends).alias("ranges"))
    q = q.select("request", "ranges", F.explode("ranges").alias("r")).select("request", "ranges", "r.*").where("NOT isnan(low)")
    sized = q.join(F.broadcast(cuts), "parameter").withColumn("n", bucket(F.col("high")) - F.size(F.filter("cuts", lambda x: x < F.col("low"))))  # in quantiles
    chosen = sized.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("n", "parameter", "low"))).where("place = 1")
    spread = chosen.select("request", "parameter", "low", "high", "ranges", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("bucket"))
    brackets, k = stage_observed(spread, "brackets")
    within = lambda h, r: (h["parameter"] == r["parameter"]) & h["value"].between(r["low"], r["high"])
    whole = F.forall("ranges", lambda r: F.exists("held", lambda h: within(h, r)))
    once = ~F.exists(F.slice("held", F.lit(1), F.col("at")), lambda h: (h["parameter"] == F.col("parameter")) & h["value"].between(F.col("low"), F.col("high")))
    met = bucket_join(brackets, k["rows"], v).where(once & whole).select("request", F.col("xid").alias("profile"))
    met, m = stage_observed(met, "met_profiles")
    members = held.join(profiles, "held").select("profile", "xid")
    return asked.join(requests, "wanted").select("query_id", "request"), n["rows"], members.join(_few(met, m["rows"]), "profile").select("request", "xid")


def bucket_join(brackets: DataFrame, n: int, values: DataFrame, few: int = FEW) -> DataFrame:
    """``n`` rows ``brackets`` (parameter, bucket, low, high, ...) with the ``values`` (parameter, bucket,
    value, xid) in them. Up to ``few`` go to every task; more meet the values by a shuffle, for
    which every bucket is dealt into parts of even size."""
    fits = F.col("value").between(F.col("low"), F.col("high"))
    if n <= few:
        return values.join(F.broadcast(brackets), ["parameter", "bucket"]).where(fits)
    partitions = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = stage_table(values.groupBy("parameter", "bucket").agg(F.count("*").alias("n")), "bucket_sizes")  # BUCKETS rows a parameter
    share = sizes.agg(F.ceil(F.sum("n") / (16 * partitions)).alias("share")).first()["share"] or 1
    sizes = F.broadcast(sizes.select("parameter", "bucket", F.ceil(F.col("n") / share).cast("int").alias("parts")))
    dealt = values.join(sizes, ["parameter", "bucket"]).withColumn("part", F.pmod(F.xxhash64("xid"), F.col("parts")).cast("int")).drop("parts")
    each = brackets.join(sizes, ["parameter", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(each, ["parameter", "bucket", "part"]).where(fits)


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, on: str | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the ``k`` nearest vectors of each query vector, exactly, by tiles
    (see ``vectors.Tiles``). With ``on``, a column of both, only vectors that equal the query in
    it are among the ``k``."""
    return Tiles(vectors, on).nearest(queries, k)


def all_terms(name: Column, wanted: Column) -> Column:
    """Every word of ``wanted`` is a word of ``name``; false where there is none to find."""
    return (F.size(words(wanted)) > 0) & (F.size(F.array_except(words(wanted), words(name))) == 0)


def related(parts: DataFrame, k: int = 10) -> DataFrame:
    """(xid, related, rank): for each part the first ``k`` others whose number contains its family.

    The distinct families are answered, not the parts: of each, the first ``k + 1`` parts by
    number are kept, so that one is left over where a part itself is among them.
    """
    own = parts.where("mpn_norm != ''").select("xid", exprs.family(F.col("mpn_norm")).alias("family"))
    n = F.col("mpn_norm")
    gram = lambda size: F.transform(F.sequence(F.lit(1), F.length(n) - (size - 1)), lambda i: F.substring(n, i, F.lit(size)))
    grams = F.array_distinct(F.concat(*[F.when(F.length(n) >= size, gram(size)).otherwise(F.array().cast("array<string>")) for size in range(1, GRAM + 1)]))
    index = parts.select(F.col("xid").alias("related"), "mpn_norm", F.explode(grams).alias("gram"))
    families = own.select("family", F.substring("family", 1, GRAM).alias("gram")).distinct()
    found = index.join(families, "gram").where(F.contains("mpn_norm", "family")).select("family", "mpn_norm", "related")
    best = top(found, ["family"], [F.asc("mpn_norm"), F.asc("related")], k + 1, "related")
    best = best.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("n", "related"))).alias("top"))
    others = F.slice(F.filter(F.transform("top", lambda s: s["related"]), lambda r: r != F.col("xid")), 1, k)
    return own.join(best, "family").select("xid", F.posexplode(others).alias("rank", "related")).select("xid", "related", (F.col("rank") + 1).alias("rank"))


def nearest(targets: DataFrame, relaxed: DataFrame, hard: DataFrame, values: DataFrame, k: int = 50, parts: DataFrame | None = None) -> DataFrame:
    """(query_id, xid, distance, rank) for queries that have quantities and no hard hit.

    ``relaxed`` (query_id, xid) are hits of the query without its quantities. Distance is the
    sum of |value - target| over the quantities (query_id, parameter, target); a part without
    a value adds nothing for it. Order: distance, the part's number if ``parts`` are given, part.
    """
    open_ = targets.join(hard.select("query_id").distinct(), "query_id", "left_anti")
    pairs = relaxed.join(hard, ["query_id", "xid"], "left_anti").join(open_, "query_id")
    met = pairs.join(values, ["xid", "parameter"], "left").groupBy("query_id", "xid").agg(F.sum(F.coalesce(F.abs(F.col("value") - F.col("target")), F.lit(0.0))).alias("distance"))
    if parts is None:
        return top(met, ["query_id"], [F.asc("distance"), F.asc("xid")], k).withColumnRenamed("n", "rank")
    met = met.join(parts.select("xid", "mpn_norm"), "xid")
    return top(met, ["query_id"], [F.asc("distance"), F.asc("mpn_norm"), F.asc("xid")], k).withColumnRenamed("n", "rank").drop("mpn_norm")


def nearest_of_groups(targets: DataFrame, queries: DataFrame, members: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """``nearest`` where the hits of a query without its quantities are the members (group, xid) of the query's
    group (query_id, group), and hard hits those of them that meet all targets.

    Queries of one group with the same targets are one request. Of members with the same values
    the first ``k`` are held against requests: all others have as many before them at any
    distance. So requests meet each different part but a few times.
    """
    table = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])
    asked = targets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("parameter", "target"))).alias("wanted")).join(queries, "query_id").select("query_id", "group", "wanted")
    asked, n = stage_observed(asked, "asked_targets")
    held = values.groupBy("xid").agg(F.array_sort(F.collect_list(F.struct("parameter", "value"))).alias("held"))
    own = members.select("group", "xid").distinct().join(held, "xid", "left").withColumn("held", F.coalesce("held", F.array().cast(held.schema["held"].dataType)))
    own = stage_table(top(own, ["group", "held"], [F.asc("xid")], k).drop("n"), "members")
    each = lambda t: F.filter("held", lambda h: h["parameter"] == t["parameter"])
    far = lambda t: F.aggregate(each(t), F.lit(0.0), lambda acc, h: acc + F.coalesce(F.abs(h["value"] - t["target"]), F.lit(0.0)))

    def hit(t: Column) -> Column:
        f = F.coalesce(F.try_element_at(table, t["parameter"]), F.lit(0.0))
        both = t["target"] * (1 - f), t["target"] * (1 + f)
        return F.exists(each(t), lambda h: F.coalesce(~F.isnan(h["value"]) & h["value"].between(F.least(*both), F.greatest(*both)), F.lit(False)))

    met = asked.select("group", "wanted").distinct().join(own, "group")
    met = stage_table(met.select("group", "wanted", "xid", F.aggregate("wanted", F.lit(0.0), lambda acc, t: acc + far(t)).alias("distance"), F.forall("wanted", hit).alias("hard")), "met_members")
    near = met.join(met.where("hard").select("group", "wanted").distinct(), ["group", "wanted"], "left_anti")
    near = top(near, ["group", "wanted"], [F.asc("distance"), F.asc("xid")], k).withColumnRenamed("n", "rank")
    return near.join(_few(asked, n["rows"]), ["group", "wanted"]).select("query_id", "xid", "distance", "rank")


def hybrid(queries: DataFrame, vectors: DataFrame, on: str, limit: int = 50) -> DataFrame:
    """(query_id, vec_id, rank, cosine): the nearest of the vectors that equal the query in ``on``, in
    order of cosine. The filter comes first, so none that fits is lost to nearer ones that do not."""
    return neighbours(queries, vectors, clamp(limit), on=on)


def resorted(near: DataFrame, parts: DataFrame, sort: str) -> DataFrame:
    """Rows (query_id, xid, cosine, rank) that were cut by cosine, placed anew by stock or price;
    by relevance they stay as they are."""
    check(sort)
    if sort == "relevance":
        return near
    rows = near.drop("rank").join(parts.select("xid", "mpn_norm", "stock", "price_usd"), "xid")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(sort)))).select("query_id", "xid", "cosine", "rank")


def semantic(queries: DataFrame, vectors: DataFrame, parts: DataFrame, values: DataFrame | None = None, *, sort: str = "relevance", limit: int = 50, **filters) -> DataFrame:
    """(query_id, xid, cosine, rank): for each query (query_id, embedding and, if wanted, raw_query) the
    parts with the nearest vectors (xid, embedding) among those that pass every filter.

    ``filters`` are those of ``filtered`` and hold for all queries: only vectors of parts that pass
    are packed, so a nearer part that fails them takes nobody's place. Quantities and a
    package in ``raw_query`` hold for that query alone; parts that meet its quantities come
    from ``matched`` over ``values`` (xid, parameter, value). What a text asks for beside its
    words is a key that tiles are kept by, so queries that ask alike share them. The first
    ``limit`` by cosine, ties by ``xid``, are then placed by ``sort``.
    """
    check(sort)
    limit = clamp(limit)
    passed = filtered(parts, **filters)
    named = vectors.select(F.col("xid").alias("vec_id"), "embedding")
    if "raw_query" not in queries.columns:
        if filters:
            named = named.join(passed.select(F.col("xid").alias("vec_id")), "vec_id", "left_semi")
        return resorted(Tiles(named).nearest(queries, limit).withColumnRenamed("vec_id", "xid"), parts, sort)
    q = queries.select("query_id", "embedding", exprs.parse_query(F.col("raw_query")).alias("p")).select("query_id", "embedding", F.coalesce("p.quantities", F.array().cast("array<struct<parameter:string,value:double>>")).alias("quantities"), "p.package")
    q, passed = stage_table(q, "semantic_queries"), stage_table(passed.select("xid", "package"), "semantic_parts")
    named = stage_table(named.join(passed.withColumnRenamed("xid", "vec_id"), "vec_id"), "semantic_vectors")
    plain = F.size("quantities") == 0
    found = Tiles(named).nearest(q.where(plain & F.col("package").isNull()), limit)
    found = found.unionByName(Tiles(named, on="package").nearest(q.where(plain & F.col("package").isNotNull()), limit))
    if values is not None:
        targets = q.select("query_id", F.explode("quantities").alias("t")).select("query_id", "t.parameter", F.col("t.value").alias("target")).distinct()
        of, _, met = matched(targets, values.join(named.select(F.col("vec_id").alias("xid")), "xid", "left_semi"))
        key = lambda package: F.concat_ws("/", F.col("request").cast("string"), package).alias("key")
        q = stage_table(q.join(of, "query_id").select("query_id", "embedding", "request", "package", key(F.col("package"))), "bound_queries")
        asked = q.select("key", "request", F.col("package").alias("wanted")).distinct()
        bound = named.join(met.withColumnRenamed("xid", "vec_id"), "vec_id").join(asked, "request").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("package")))
        bound = stage_table(bound.select("key", "vec_id", "embedding"), "bound_vectors")
        found = found.unionByName(Tiles(bound, on="key").nearest(q, limit))
    return resorted(found.withColumnRenamed("vec_id", "xid"), parts, sort)


#: The keys of a result, in their order.
RESULT = ("mpn", "mpn_norm", "manufacturer", "package", "category", "stock", "is_basic", "price_usd", "match_type", "similarity", "datasheets", "params")


#: Lists that ``expanded`` adds, by the edge table that each is read from.
REACHED = {"makers": "made_by", "categories": "in_category", "packages": "in_package", "tags": "tagged"}


def expanded(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (xid, ...) with what each part's edges lead to: ``makers``, ``categories`` (the parent before
    the name), ``packages`` and ``tags``, each a sorted list of names, and ``sheets``, a list of
    (url, http_status, fail_count) in order of url.

    Edges of the parts that are asked for are gathered in one shuffle, whatever their kind. A part
    without edges, or one that is unknown, has empty lists; a link without a datasheet row has
    nulls. Columns of ``rows`` that have one of these names are replaced.
    """
    asked, none = rows.select("xid").distinct(), F.lit(None).cast("int")
    name = {"in_category": F.concat_ws(" > ", "parent_name", "name")}
    links = tables["datasheet_of"].join(asked, "xid", "left_semi").join(tables["datasheet"].select("url", "http_status", "fail_count"), "url", "left")
    edges = links.select("xid", F.lit("sheets").alias("kind"), F.col("url").alias("name"), "http_status", "fail_count")
    for kind, table in REACHED.items():
        of = tables[table].select("xid", F.lit(kind).alias("kind"), name.get(table, F.col("name")).alias("name"), none.alias("http_status"), none.alias("fail_count"))
        edges = edges.unionByName(of.join(asked, "xid", "left_semi"))
    listed = lambda kind, value: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, value))).alias(kind)
    sheet = F.struct(F.col("name").alias("url"), "http_status", "fail_count")
    found = edges.groupBy("xid").agg(*[listed(k, F.col("name")) for k in REACHED], listed("sheets", sheet))
    added = [*REACHED, "sheets"]
    out = rows.drop(*added).join(found, "xid", "left")
    return out.withColumns({k: F.coalesce(k, F.array().cast(found.schema[k].dataType)) for k in added})


def shaped(rows: DataFrame, parts: DataFrame, sheets: DataFrame, parameters: list[str]) -> DataFrame:
    """Ranked rows (query_id, rank, xid, tier, ...) with the ``RESULT`` keys: scalars of the part, its
    datasheets (edges (xid, url)) in order, and the parameters that it has."""
    urls = sheets.groupBy("xid").agg(F.array_sort(F.collect_set("url")).alias("datasheets"))
    names = F.create_map(*[F.lit(x) for kv in MATCH_TYPES.items() for x in kv])
    found = parts.select("xid", *RESULT[:8], exprs.sparse(parameters).alias("params"))
    similarity = F.col("similarity") if "similarity" in rows.columns else F.lit(None).cast("double")
    keep = [c for c in ("query_id", "rank", "nearest_match") if c in rows.columns]
    rows = rows.select(*keep, "xid", names[F.col("tier")].alias("match_type"), similarity.alias("similarity")).join(found, "xid").join(urls, "xid", "left")
    return rows.withColumn("datasheets", F.coalesce("datasheets", F.array().cast("array<string>"))).select(*keep, *RESULT)


def result_documents(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, json): each query's document {version, query, nearest_match, count, results}, of rows
    as ``shaped`` gives them; one without rows has no results. Absent scalars are null."""
    each = rows.where(F.col("rank") <= 3 * MOST_RESULTS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *RESULT)), lambda a, b: a["rank"] - b["rank"]).alias("r"), F.bool_or("nearest_match").alias("nearest_match"))
    each = queries.select("query_id", F.col("raw_query").alias("query")).join(each, "query_id", "left")
    results = F.coalesce(F.transform("r", lambda s: F.struct(*[s[f].alias(f) for f in RESULT])), F.array())
    document = F.struct(F.lit(1).alias("version"), "query", F.coalesce("nearest_match", F.lit(False)).alias("nearest_match"), F.coalesce(F.size("r"), F.lit(0)).alias("count"), results.alias("results"))
    return each.select("query_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def result_json(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, json): each query's ranked rows with some fields as a short document; nulls are left out."""
    each = rows.where(F.col("rank") <= 3 * MOST_RESULTS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("r"))
    return each.select("query_id", F.to_json(F.struct(F.lit(1).alias("version"), F.size("r").alias("count"), F.transform("r", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("results"))).alias("json"))
