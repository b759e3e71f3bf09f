"""Keeping the catalogue fresh: stock, links, staleness, embedding reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..sources.ledger import write_observed

MOST_STOCK, MOST_PRICE = 1e9, 1e6


def stale(stamp: Column, now: Column, days: int) -> Column:
    return stamp.isNull() | (stamp < now - F.make_dt_interval(F.lit(days)))


def stock_merge(parts: DataFrame, source: DataFrame) -> DataFrame:
    """Parts (lcsc_id, stock, price_usd) with the source's sane values where it knows the part."""
    p, s = parts.alias("p"), source.alias("s")
    joined = p.join(s, F.col("p.lcsc_id") == F.col("s.lcsc_id"), "left")
    return joined.select("p.lcsc_id", exprs.sane(F.col("s.stock"), F.col("p.stock"), MOST_STOCK).alias("stock"), exprs.sane(F.col("s.price_usd"), F.col("p.price_usd"), MOST_PRICE).alias("price_usd"), F.col("s.lcsc_id").isNotNull().alias("matched"))


def stock_index(source: DataFrame) -> DataFrame:
    """(lcsc_id, stock, price_usd, is_basic): of each part's rows the one that is last by ``pos``, ties
    broken by its values; rows without an id are left out."""
    row = F.struct("stock", "price_usd", "is_basic")
    return source.where("lcsc_id IS NOT NULL").groupBy("lcsc_id").agg(F.max_by(row, F.struct("pos", "stock", "price_usd", "is_basic")).alias("r")).select("lcsc_id", "r.*")


def stock_write_back(parts: DataFrame, source: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Parts after a refresh of those that have an id and were not checked for ``days``.

    A part that the source knows takes its sane values and its ``is_basic``, null being false,
    and the stamp; one that it does not know takes the stamp alone. All columns are kept, and
    ``outcome`` tells what happened: matched, absent or fresh.
    """
    due = F.col("lcsc_id").isNotNull() & stale(F.col("stock_checked_at"), now, days)
    s = stock_index(source).select("lcsc_id", *[F.col(c).alias(f"__{c}") for c in ("stock", "price_usd", "is_basic")], F.lit(True).alias("__known"))
    rows = parts.withColumn("__due", due).join(s, "lcsc_id", "left")
    hit = F.col("__due") & F.coalesce("__known", F.lit(False))
    new = {
        "stock": F.when(hit, exprs.sane(F.col("__stock"), F.col("stock"), MOST_STOCK)).otherwise(F.col("stock")),
        "price_usd": F.when(hit, exprs.sane(F.col("__price_usd"), F.col("price_usd"), MOST_PRICE)).otherwise(F.col("price_usd")),
        "is_basic": F.when(hit, F.coalesce("__is_basic", F.lit(False))).otherwise(F.col("is_basic")),
        "stock_checked_at": F.when(F.col("__due"), now).otherwise(F.col("stock_checked_at")),
    }
    outcome = F.when(hit, "matched").when(F.col("__due"), "absent").otherwise("fresh")
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in parts.columns], outcome.alias("outcome"))


def stock_figures() -> dict[str, Column]:
    """Parts checked, matched and absent, to be observed while a ``stock_write_back`` is written."""
    of = lambda k: F.count_if(F.col("outcome") == k)
    return {"checked": F.count_if(F.col("outcome") != "fresh"), "matched": of("matched"), "absent": of("absent")}


def stock_summary(written: DataFrame) -> DataFrame:
    """One row: ``stock_figures`` of a table."""
    return written.agg(*[v.alias(k) for k, v in stock_figures().items()])


def link_write_back(sheets: DataFrame, edges: DataFrame, checks: DataFrame, now: Column, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Datasheets (url, verified_at, http_status, fail_count, ...) and edges (xid, url) after ``checks``
    (url, status), and what was purged.

    A checked link takes the stamp, its status and its counter: 0 if alive, else one more. After
    that a dead link whose counter has reached ``most`` goes, with its edges; ``purged`` is
    (url, fail_count, parts_unlinked). Several checks of a link count as one, the best.
    """
    written = _links_checked(sheets, checks, now)
    gone = _purgeable(written, most)
    purged = gone.join(edges, "url", "left").groupBy("url", "fail_count").agg(F.countDistinct("xid").alias("parts_unlinked"))
    left = lambda df: df.join(gone.select("url"), "url", "left_anti")
    return left(written.select(*sheets.columns)), left(edges), purged


def _links_checked(sheets: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Datasheets with what their checks say and ``alive``, null for those not checked."""
    seen = checks.groupBy("url").agg(F.min_by("status", F.struct(~exprs.link_status(F.col("url"), F.col("status"))["alive"], "status")).alias("status"))
    seen = seen.select("url", exprs.link_status(F.col("url"), F.col("status")).alias("c"))
    rows = sheets.join(seen, "url", "left")
    checked = F.col("c").isNotNull()
    count = F.when(F.col("c.alive"), 0).otherwise(F.coalesce("fail_count", F.lit(0)) + 1)
    new = {"verified_at": now, "http_status": F.col("c.http_status"), "fail_count": count}
    return rows.select(*[(F.when(checked, new[k]).otherwise(F.col(k)).cast(sheets.schema[k].dataType).alias(k) if k in new else F.col(k)) for k in sheets.columns], F.when(checked, F.col("c.alive")).alias("__alive"))


def _purgeable(written: DataFrame, most: int) -> DataFrame:
    return written.where(~F.coalesce("__alive", F.lit(True)) & (F.col("fail_count") >= most)).select("url", "fail_count")


def write_links(sheets: DataFrame, edges: DataFrame, checks: DataFrame, now: Column, path: str, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """``link_write_back`` written under the new folder ``path``, with its summary: links checked, alive,
    dead and purged, all counted by the one write of the links."""
    spark = sheets.sparkSession
    rows = _links_checked(sheets, checks, now)
    dead = ~F.coalesce("__alive", F.lit(True))
    figures = write_observed(rows, f"{path}/checked", checked=F.count("__alive"), alive=F.count_if("__alive"), dead=F.count_if(dead), purged=F.count_if(dead & (F.col("fail_count") >= most)))
    written = spark.read.parquet(f"{path}/checked")
    gone = _purgeable(written, most)
    purged = gone.join(edges, "url", "left").groupBy("url", "fail_count").agg(F.countDistinct("xid").alias("parts_unlinked"))
    stays = F.coalesce("__alive", F.lit(True)) | F.coalesce(F.col("fail_count") < most, F.lit(True))
    return written.where(stays).select(*sheets.columns), edges.join(gone.select("url"), "url", "left_anti"), purged, {k: figures[k] for k in ("checked", "alive", "dead", "purged")}


def link_summary(sheets: DataFrame, checks: DataFrame, purged: DataFrame) -> DataFrame:
    """One row: links checked, alive, dead and purged."""
    seen = sheets.select("url").join(checks.select("url", exprs.link_status(F.col("url"), F.col("status"))["alive"].alias("alive")).groupBy("url").agg(F.bool_or("alive").alias("alive")), "url")
    counts = seen.agg(F.count("*").alias("checked"), F.count_if("alive").alias("alive"), F.count_if(~F.col("alive")).alias("dead"))
    return counts.crossJoin(purged.agg(F.count("*").alias("purged")))  # one row each


def holders(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, xid): the parts that link to each of ``urls``."""
    return edges.join(urls.select("url").distinct(), "url").select("url", "xid")


def fail_counts(checks: DataFrame) -> DataFrame:
    """(url_id, fail_count): failed checks of each link since its last good one.

    ``checks`` is (url_id, seq, alive). Two aggregations: the last good check, then the
    failures after it.
    """
    last = checks.where("alive").groupBy("url_id").agg(F.max("seq").alias("good"))
    joined = checks.join(last, "url_id", "left")
    return joined.groupBy("url_id").agg(F.count_if(~F.col("alive") & (F.col("good").isNull() | (F.col("seq") > F.col("good")))).alias("fail_count"))


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each ``key`` that is first by ``order``, nulls first; a null key is one of its own. A minimum,
    taken in part before the shuffle, so a key with most of the rows is no single task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("key")).agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")


def embed_action(text: Column, stored_hash: Column, has_vector: Column) -> Column:
    """What to do with a part's vector: none, embed, backfill, skip or reembed."""
    fresh = F.sha2(text, 256)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "none").when(~has_vector, "embed").when(stored_hash.isNull(), "backfill").when(stored_hash == fresh, "skip").otherwise("reembed")


def schedule(urls: DataFrame, spacing: float, shares: int = 64) -> DataFrame:
    """(url_id, host, start): seconds after which each link (url_id, url) may be checked, so that a
    host is asked once every ``spacing`` seconds. Numbers are dealt within hash shares of a
    host, which follow one another, so a host with most of the links is no single task."""
    u = urls.select("url_id", exprs.host(F.col("url")).alias("host"), F.pmod(F.xxhash64("url_id"), F.lit(shares)).alias("share"))
    sizes = u.groupBy("host", "share").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("host", "share", before.alias("before"))
    own = u.withColumn("i", F.row_number().over(Window.partitionBy("host", "share").orderBy("url_id")) - 1)
    return own.join(offsets, ["host", "share"]).select("url_id", "host", ((F.col("before") + F.col("i")) * spacing).alias("start"))
