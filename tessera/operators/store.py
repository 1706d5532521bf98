"""The store's scans, queues and migrations as tables: each mutation returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import folded, key_groups

#: States of the work queue, attempts before a dead letter, and characters of an error that are kept.
STATUSES = "pending enriched failed permanent_failure skipped".split()
MOST_ATTEMPTS, ERROR_CHARS = 3, 500


def scan(rows: DataFrame, order: list[Column], equal: dict | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
    """Optional equal and inclusive range predicates, None being no predicate; in order."""
    for c, v in (equal or {}).items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    for c, (lo, hi) in (between or {}).items():
        if lo is not None:
            rows = rows.where(F.col(c) >= lo)
        if hi is not None:
            rows = rows.where(F.col(c) <= hi)
    return rows.orderBy(*order)


def workable(rows: DataFrame, status: str, attempts: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Pending or failed, with attempts left."""
    return rows.where(F.col(status).isin("pending", "failed") & (F.col(attempts) < most))


def enqueued(log: DataFrame, key: str, reason: str, order: list[str], at: str) -> DataFrame:
    """Requests folded by key in order: the last reason; a generation that is the request's time or, if that isn't later, one more than before; attempts 0.

    The generation after request i is max over j <= i of (time j + i - j): a running maximum.
    """
    w = Window.partitionBy(key).orderBy(*order)
    i = F.row_number().over(w)
    rows = log.select(key, F.col(reason).alias("reason"), F.struct(*order).alias("o"), F.col(at).alias("at"), i.alias("i"))
    return rows.groupBy(key).agg(F.max_by("reason", "o").alias("reason"), (F.max(F.col("at") - F.col("i")) + F.max("i")).alias("generation"), F.count(F.lit(1)).alias("requests")).withColumn("attempts", F.lit(0))


def done(queue: DataFrame, finished: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Without entries that were finished in their present generation; newer ones stay."""
    return queue.join(finished.select(key, generation), [key, generation], "left_anti")


def failed(queue: DataFrame, failures: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Attempts grow by the failures of the present generation; dead tells who has none left."""
    n = failures.groupBy(key, generation).agg(F.count(F.lit(1)).alias("more"))
    got = queue.join(n, [key, generation], "left").withColumn("attempts", F.col("attempts") + F.coalesce("more", F.lit(0))).drop("more")
    return got.withColumn("dead", F.col("attempts") >= MOST_ATTEMPTS)


def transitions(log: DataFrame, key: str, state: str, error: str, order: list[str]) -> DataFrame:
    """Each key's last state, attempts (changes to failed), last error cut at 500 characters, and whether it is final."""
    at = F.struct(*order)
    got = log.groupBy(key).agg(F.max_by(state, at).alias("status"), F.sum((F.col(state) == "failed").cast("long")).alias("attempts"), F.max_by(F.when(F.col(state).isin("failed", "permanent_failure"), F.substring(error, 1, ERROR_CHARS)), at).alias("error"))
    return got.withColumn("final", F.col("status").isin("enriched", "permanent_failure", "skipped") | (F.col("attempts") >= MOST_ATTEMPTS))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """Known statuses with their counts, 0 included."""
    known = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def merged(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Arrivals, in order, fold into the row they match by the first of keys that hits, else become a row. Values stay, NULLs are filled;
    a key is filled only if no other row has it. An arrival sees what earlier ones did.

    Rows and arrivals that keys tie together, however many steps apart, are folded one after the other; groups that share no key apart from each other. Those without
    any key match nothing: old rows stay, arrivals are left out.
    """
    token = F.array_compact(F.array(*(F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in keys)))
    some = F.coalesce(*(F.col(k).cast("string") for k in keys)).isNotNull()
    rows = old.select(F.lit(0).alias("late"), *(F.lit(None).cast(new.schema[c].dataType).alias(f"o_{c}") for c in order), *keys, *columns)
    rows = rows.unionByName(new.where(some).select(F.lit(1).alias("late"), *(F.col(c).alias(f"o_{c}") for c in order), *keys, *columns)).withColumn("tokens", token)
    group = key_groups(rows, "tokens")
    named = rows.where(F.size("tokens") > 0).withColumn("token", F.col("tokens")[0]).join(group, "token").drop("token", "tokens")
    n, width = len(keys), len(keys) + len(columns)
    first = 1 + len(order)

    def fold(group):
        have, where = [], [{} for _ in range(n)]
        for row in group:
            got = list(row[first : first + width])
            hit = next((where[i][got[i]] for i in range(n) if got[i] is not None and got[i] in where[i]), None) if row[0] else None
            if hit is None:
                hit = len(have)
                have.append(got)
            else:
                mine = have[hit]
                for i in range(width):
                    if mine[i] is None and (i >= n or got[i] not in where[i]):
                        mine[i] = got[i]
            for i in range(n):
                if have[hit][i] is not None:
                    where[i].setdefault(have[hit][i], hit)
        yield from map(tuple, have)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, *columns).schema)
    put = folded(named, ["label"], [F.col("late"), *(F.col(f"o_{c}") for c in order), *map(F.col, keys)], schema, fold)
    return put.unionByName(rows.where((F.size("tokens") == 0) & (F.col("late") == 0)).select(*keys, *columns))


def set_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where the condition holds."""
    return rows.select(*(F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def frozen(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first write of a key wins, for good."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def without_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """M20."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def offsets(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The stored offset of each key, the last one given."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(value, F.struct("_p", value)).alias(value))


def next_offset(seen: DataFrame, id_: str, ok: str) -> DataFrame:
    """The least id that failed, else one after the highest; one row, NULL if nothing was seen."""
    return seen.agg(F.coalesce(F.min(F.when(~F.col(ok), F.col(id_))), F.max(id_) + 1).alias("next"))


def migrated(rows: DataFrame, schema: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The table in its new columns; missing ones are NULL; a table without a required column is refused."""
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"incompatible table: no column {', '.join(lacking)}")
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def broken_keys(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows that break the table's rules: no key at all, or a key that an other row has."""
    named = [(f"_k{i}", k) for i, k in enumerate(keys)]
    got = rows.select("*", *(k.alias(n) for n, k in named))
    several = F.lit(False)
    for n, _ in named:
        several = several | (F.col(n).isNotNull() & (F.count(n).over(Window.partitionBy(n)) > 1))
    none = F.coalesce(*(F.col(n).cast("string") for n, _ in named)).isNull()
    return got.withColumn("fault", F.when(none, "no key").when(several, "repeated key")).where("fault is not null").drop(*(n for n, _ in named))


def colliding_slugs(slugs: DataFrame) -> DataFrame:
    """Slug, namespaces (in order) of slugs(namespace, slug) that are malformed or stand in several namespaces."""
    got = slugs.groupBy("slug").agg(F.array_sort(F.collect_set("namespace")).alias("namespaces"))
    bad = ~F.coalesce(F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False))
    return got.where(bad | (F.size("namespaces") > 1)).select("slug", F.array_join("namespaces", ",").alias("namespaces"), F.when(bad, "malformed").otherwise("collision").alias("fault"))


def namespace_of(static: DataFrame, observed: DataFrame) -> DataFrame:
    """Slug, namespace; observed slugs overwrite the static ones."""
    both = static.select("slug", "namespace", F.lit(0).alias("p")).union(observed.select("slug", "namespace", F.lit(1).alias("p")))
    return both.groupBy("slug").agg(F.max_by("namespace", F.struct("p", "namespace")).alias("namespace"))


def rebuild_dates(dates: DataFrame, built: DataFrame, today: Column) -> DataFrame:
    """Dates that lack a build, or changed after it, with yesterday and today; distinct, in order."""
    stale = dates.join(built, "date", "left").where(F.col("built_at").isNull() | (F.col("changed_at") > F.col("built_at"))).select("date")
    near = dates.sparkSession.range(2).select(F.date_sub(today.cast("date"), F.col("id").cast("int")).alias("date"))
    return stale.union(near).distinct().orderBy("date")


def new_ids(current: DataFrame, baseline: DataFrame | None, key: str) -> DataFrame:
    """Ids that the baseline lacks; without a baseline nothing is new."""
    return current.limit(0) if baseline is None else current.join(baseline.select(key).distinct(), key, "left_anti")
