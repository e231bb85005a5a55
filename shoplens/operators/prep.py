"""Data preparation: recoding values and publishing the tables.

``recode`` and ``apply_updates`` replace the reference's in-place ``UPDATE ...
SET col = new WHERE key = old`` statements: they return a new DataFrame
instead of mutating a table. ``publish`` replaces ``RENAME TABLE`` into a new
schema: it writes the tables to a new location, makes them visible together and can check the row counts read
back.
"""

from __future__ import annotations

from functools import reduce

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.sources import versions
from shoplens.sources.tables import BUCKET_KEYS, SCHEMAS, SUMMARY_OF, ShopTables, published_summary, read_published, table_bytes

# The reference's product renames (id -> new name) and
# product page renames (old URL -> new URL), in the order it applies them.
PRODUCT_NAMES = {
    1: "High Score Hoodie",
    2: "PowerUp Pants",
    3: "Cheatcode Cap",
    4: "Sidequest Shirt",
}
PRODUCT_URLS = {
    "/the-original-mr-fuzzy": "/high-score-hoodie",
    "/the-forever-love-bear": "/power-up-pants",
    "/the-birthday-sugar-panda": "/cheat-code-cap",
    "/the-hudson-river-mini-bear": "/side-quest-shirt",
}


def recode(
    df: DataFrame,
    key_col: str,
    target_col: str,
    mapping: Mapping | DataFrame,
    collation: str | None = None,
) -> DataFrame:
    """Set ``target_col`` to ``mapping[key]`` where the key is mapped.

    Rows whose key is not mapped keep their value, and the row count never
    changes. A dict becomes a literal map looked up inside the projection
    (no join). A DataFrame mapping (first column key, second new value) is
    left-joined; Spark's own size check decides whether it is broadcast. A
    mapping has no order, so a key that it holds twice is an error when the result is
    computed; ``apply_updates`` takes statements in order. ``collation`` (e.g. ``UNICODE_CI_AI``)
    makes key matching case/accent-insensitive; keys that it holds equal are
    one key held twice. NULL keys match nothing; a NULL new value is set.
    """
    if isinstance(mapping, DataFrame) or collation is not None:
        if not isinstance(mapping, DataFrame):
            spark = df.sparkSession
            mapping = spark.createDataFrame(
                [(k, v) for k, v in mapping.items()],
                schema=df.select(F.col(key_col).alias("k"), F.col(target_col).alias("v")).schema,
            )
        k, v = mapping.columns[:2]
        key = F.col(k) if collation is None else F.collate(F.col(k), collation)
        lookup = mapping.where(F.col(k).isNotNull()).select(key.alias("__recode_key"), F.col(v).alias("__recode_new"))
        once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"recode of {target_col}: a key is mapped twice")).cast("boolean"))
        lookup = lookup.groupBy("__recode_key").agg(
            F.max("__recode_new").alias("__recode_new"), once.otherwise(True).alias("__recode_hit"))
        probe = F.col(key_col) if collation is None else F.collate(F.col(key_col), collation)
        joined = df.join(lookup, probe == F.col("__recode_key"), "left")
        out = F.when(F.col("__recode_hit"), F.col("__recode_new")).otherwise(F.col(target_col))
        return joined.select(
            *[out.alias(c) if c == target_col else F.col(c) for c in df.columns])
    pairs = [F.lit(x) for kv in mapping.items() if kv[0] is not None for x in kv]
    if not pairs:
        return df
    table = F.create_map(*pairs)
    out = F.when(F.map_contains_key(table, F.col(key_col)), F.element_at(table, F.col(key_col))).otherwise(F.col(target_col))
    return df.select(*[out.alias(c) if c == target_col else F.col(c) for c in df.columns])


def compose_updates(updates: Sequence[tuple], same_column: bool, key_of: Mapping | None = None) -> dict:
    """One look-up with the effect of ``UPDATE .. SET target = new WHERE key = old`` statements in order.

    With ``same_column`` the key is the target itself, so an update sees what
    earlier ones made: a to b, then b to c sends both a and b to c. Otherwise
    the last update of a key wins. ``key_of`` maps values to what a collation compares.
    """
    key = (lambda v: v) if key_of is None else key_of.__getitem__
    now: dict = {}  # key of an original value -> (its spelling, the value it has by now)
    holders: dict = {}  # key of a value -> keys of the original values that have become it
    for old, new in updates:
        if old is None:  # no row equals NULL
            continue
        mine = key(old)
        if not same_column:
            now[mine] = (old, new)
            continue
        moved = holders.pop(mine, set())
        if mine not in now:
            moved.add(mine)
            now[mine] = (old, old)
        for origin in moved:
            now[origin] = (now[origin][0], new)
        if new is not None:
            holders.setdefault(key(new), set()).update(moved)
    return {spelling: value for spelling, value in now.values()}


def apply_updates(
    df: DataFrame, key_col: str, target_col: str, updates: Sequence[tuple], collation: str | None = None,
) -> DataFrame:
    """``df`` after the updates (old, new) in their order, in one projection or one look-up join.

    ``updates`` is a script's list of statements; under a ``collation`` one small
    query over its values finds which of them compare as equal.
    """
    key_of = None
    same = key_col == target_col
    if collation is not None:
        values = sorted({v for pair in updates for v in (pair if same else pair[:1]) if v is not None})
        if not values:
            return df
        table = df.sparkSession.createDataFrame([(v,) for v in values], df.select(F.col(key_col).alias("v")).schema)
        classes = table.groupBy(F.collate("v", collation).alias("k")).agg(F.collect_list("v").alias("vs"))
        key_of = {v: min(r["vs"]) for r in classes.select("vs").collect() for v in r["vs"]}
    return recode(df, key_col, target_col, compose_updates(updates, same, key_of), collation)


BYTES_PER_BUCKET = 8 << 20


def publish(
    tables: ShopTables, root: str, derived: bool = True,
    catalog_prefix: str | None = None, buckets: int | None = None, check_keys: bool = False,
) -> str:
    """Write every table as Parquet under ``root``; return ``root``.

    With ``catalog_prefix`` the tables are also registered in the catalog as
    ``<prefix><name>``, one by one, and bucketed on their join key (``BUCKET_KEYS``) into
    ``buckets`` buckets (default: one per ``BYTES_PER_BUCKET``), one
    sorted file per bucket: joins and aggregations on those keys then run
    without a shuffle of the bucketed side. Read them with
    :func:`shoplens.sources.tables.read_catalog`.

    With ``derived`` the per-session summary is computed once from the
    published pageviews and written as ``session_summary``; the
    landing-page and pageview-count reports then scan it instead of each
    re-aggregating the pageviews.

    Without a prefix all tables become visible at once, by one commit record
    (:mod:`shoplens.sources.versions`): a reader sees the old copy or the new
    one, and a publish that dies leaves the old one. The summary is
    recorded with the version of the pageviews that it was made from, and readers
    do not believe it for others.

    With ``check_keys`` a copy whose claimed keys do not hold (:func:`require_keys`)
    is not made visible; catalog tables are checked before the first write.

    Each write is its own committed job (Spark's file commit protocol), so
    a lost executor only re-runs its tasks.
    """
    spark = tables.orders.sparkSession
    n = buckets or max(spark.sparkContext.defaultParallelism, -(-sum(table_bytes(df) for _, df in tables.items()) // BYTES_PER_BUCKET))
    from shoplens.operators.website import session_summary

    if catalog_prefix is None:
        folder = versions.new_folder(root)
        paths = {}
        for name, df in tables.items():
            paths[name] = [f"{folder}/{name}"]
            df.write.parquet(paths[name][0])
        if check_keys:
            require_keys(ShopTables(**{name: spark.read.parquet(*path) for name, path in paths.items()}))
        record = {"tables": paths}
        if derived:
            record |= _write_summary(session_summary, spark.read.parquet(*paths["website_pageviews"]), folder)
        versions.commit(spark, root, record)
        return root

    if check_keys:
        require_keys(tables)
    for name, df in tables.items():
        publish_table(name, df, root, catalog_prefix, n)
    if derived:
        publish_summary(spark.table(f"{catalog_prefix}website_pageviews"), root, catalog_prefix, n)
    return root


def publish_table(name: str, df: DataFrame, root: str, catalog_prefix: str, buckets: int) -> None:
    """Write one table to the catalog, bucketed on its key."""
    key = BUCKET_KEYS.get(name)
    if key is not None:
        df = df.repartition(buckets, key)
    w = df.write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
    if key is not None:
        w = w.bucketBy(buckets, key).sortBy(key)
    w.saveAsTable(f"{catalog_prefix}{name}")


def publish_summary(pageviews: DataFrame, root: str, catalog_prefix: str, buckets: int) -> None:
    """Write the session summary of the catalog's pageviews, with their version as a property."""
    from shoplens.operators.website import session_summary

    publish_table("session_summary", session_summary(pageviews), root, catalog_prefix, buckets)
    pageviews.sparkSession.sql(
        f"ALTER TABLE {catalog_prefix}session_summary SET TBLPROPERTIES ('{SUMMARY_OF}' = '{versions.source_version(pageviews)}')")


def require_keys(tables: ShopTables) -> None:
    """An error that names every table whose claimed key is NULL or repeated on some row (a job over the key columns)."""
    from shoplens.operators.audits import key_audit

    broken = key_audit(tables).where("null_keys > 0 or repeated_keys > 0").collect()
    if broken:
        raise ValueError("claimed keys do not hold: " + "; ".join(
            f"{r.table_name}.{r.key_name}: {r.null_keys} rows without a key, {r.repeated_keys} repeated keys" for r in broken))


def _write_summary(summary, pageviews: DataFrame, folder: str) -> dict:
    """Write a summary; what the commit record says of it."""
    path = f"{folder}/session_summary"
    summary(pageviews).write.parquet(path)
    return {"summary": [path], "summary_of": versions.source_version(pageviews)}


def append_pageviews(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Add pageviews to a published copy and keep its session summary up.

    Only the new rows are aggregated; their summary is merged with the
    published one, session by session. A summary that is absent or stale is rebuilt. New
    rows and summary become visible together.
    """
    from shoplens.operators.website import merge_summaries, session_summary

    record = versions.latest(spark, root)
    if record is None:
        raise ValueError(f"{root}: nothing is published there")
    folder = versions.new_folder(root)
    new = f"{folder}/website_pageviews"
    rows.select(*SCHEMAS["website_pageviews"]).write.parquet(new)
    before = record["tables"]["website_pageviews"]
    old = published_summary(spark, record)
    after = spark.read.parquet(*before, new)
    if old is None:
        made = _write_summary(session_summary, after, folder)
    else:
        fresh = session_summary(spark.read.parquet(new))
        made = _write_summary(lambda _: merge_summaries(old, fresh), after, folder)
    changed = record | {"tables": record["tables"] | {"website_pageviews": [*before, new]}} | made
    versions.commit(spark, root, changed, after=record["version"])


def row_counts(tables: ShopTables) -> DataFrame:
    """Rows per base table, e.g. of a published copy read back."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def published_counts(tables: ShopTables, root: str) -> dict[str, tuple[int, int]]:
    """(rows in source, rows read back) per table, for publish checks."""
    back = dict(read_published(tables.orders.sparkSession, root).items())
    return {name: (df.count(), back[name].count()) for name, df in tables.items()}


def inspect(df: DataFrame, n: int = 20) -> DataFrame:
    """``SELECT * ... LIMIT n`` for eyeballing a table (the limit is the feature)."""
    return df.limit(n)
