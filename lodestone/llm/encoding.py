"""Time-ordered target encoding over an hour cube.

A row's history is what other folds hold at earlier instants under the same key. A key of at most MOST rows is one
cell of time. The time of any other key is cut into hours, whose sums by fold (the cube, aggregated in each task first)
are summed up in order by a window of the key, so that each hour knows all closed hours before it. Within its own cell
a row's history is exact to the microsecond. An hour that holds more than MOST rows is cut into minutes, these into
seconds, milliseconds and at last microseconds, where rows of one instant are one cell that needs no more than its
sums; each level is summed up within its parent only, so that no window has more rows than a cell has parts, times
folds. Rows meet the sums of their cell in a join on key and cell, and the windows that follow use its exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Microseconds of a cell on each level, from hours to one.
WIDTHS = (3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
#: Rows of a cell that are not cut further.
MOST = 4096
#: Cells whose table is broadcast, well below a megabyte.
FEW = 10_000
FOLDS, PRIOR, WEIGHT, UNIT = 5, 500_000, 50, 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, by its calendar in the session's zone."""
    day, second = F.unix_date(ts.cast("date")), F.extract(F.lit("SECOND"), ts)
    return day.cast("long") * 86_400_000_000 + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (second * 1_000_000).cast("long")


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """The fold of a whole number: the unsigned CRC-32 of its decimal digits, modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")


def rate(n: Column, s: Column, prior: Column) -> Column:
    """The prior without history, else the smoothed share in millionths, in whole numbers rounded down."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", s * UNIT + prior * WEIGHT, n + WEIGHT))


@dataclass
class Cells:
    """The cells of one key column: those that are cut further on each level, and what lies before each that is not."""

    dense: list[DataFrame]
    base: DataFrame | None


def _cell(t: Column, level: int) -> Column:
    """The start of the cell of a level with the level in its last three bits; 0 is all time."""
    return (t - F.pmod(t, F.lit(WIDTHS[level - 1]))) * 8 + level


def _before(column: str, keys: list[str], order: str) -> Column:
    """What other folds than the row's own hold in ``column`` earlier in ``order``."""
    every, own = (Window.partitionBy(*k).orderBy(order).rangeBetween(Window.unboundedPreceding, -1) for k in (keys, [*keys, "fold"]))
    return F.coalesce(F.sum(column).over(every), F.lit(0)) - F.coalesce(F.sum(column).over(own), F.lit(0))


def cells(rows: DataFrame, key: str, scratch: C.Scratch, most: int = MOST, folds: int = FOLDS) -> Cells:
    """Cells of a written table of (key, t, fold, n, s); the key is never null."""
    rows = rows.select(F.col(key).alias("k"), "t", "fold", "n", "s")
    dense = []

    def cut_further(table):
        """Whether there are such cells; they are broadcast if their checked number allows it."""
        table = scratch.put(table)
        n = table.count()
        if n:
            dense.append(F.broadcast(table) if n <= FEW else table)
        return n > 0

    if not cut_further(rows.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > most).select("k")):
        return Cells([], None)
    bases, above = [], None
    rows = rows.join(dense[0], "k", "left_semi").withColumn("up", F.lit(0).cast("long"))
    for level in range(1, len(WIDTHS) + 1):
        cube = rows.groupBy("k", "up", _cell(F.col("t"), level).alias("cell"), "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("m"))
        sums = scratch.put(cube).withColumns({"m": F.sum("m").over(Window.partitionBy("k", "up", "cell"))} | {f"before_{c}": _before(c, ["k", "up"], "cell") for c in "ns"})
        if above is not None:  # and what lies before the cell above
            sums = sums.join(above.select("k", F.col("cell").alias("up"), "fold", F.col("before_n").alias("a_n"), F.col("before_s").alias("a_s")), ["k", "up", "fold"])
            sums = sums.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"a_{c}") for c in "ns"})
        sums = scratch.put(sums.select("k", "cell", "fold", "before_n", "before_s", "m"))
        above = sums.where(F.col("m") > most)
        cut = above.select("k", "cell", F.ceil(F.col("m") / most).cast("int").alias("parts")).distinct()
        if level == len(WIDTHS):
            # an instant has nothing before its rows but its base: they need not stay together
            bases.append(sums.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / most) - 1).cast("int")))))
            cut_further(cut)
            break
        bases.append(sums.where(F.col("m") <= most).withColumn("salt", F.lit(0)))
        if not cut_further(cut):
            break
        rows = rows.withColumn("up", _cell(F.col("t"), level)).join(dense[-1].select("k", F.col("cell").alias("up")), ["k", "up"], "left_semi")
        rows = scratch.put(rows.select("k", "t", "fold", "n", "s", "up"))
    base = bases[0]
    for b in bases[1:]:
        base = base.unionByName(b)
    # a cell's folds in one row, so that rows meet it by key and cell
    each = [F.max(F.when(F.col("fold") == f, F.struct(F.col("before_n").alias("n"), F.col("before_s").alias("s")))) for f in range(folds)]
    return Cells(dense, scratch.put(base.groupBy("k", "cell", "salt").agg(F.array(*each).alias("before"))))


def history(rows: DataFrame, key: str, found: Cells, n: str, s: str) -> DataFrame:
    """``rows`` (key, t, fold, n, s, ...) with the count and the sum of their history as columns ``n`` and ``s``."""
    names = rows.columns
    rows = rows.withColumns({"__cell": F.lit(0).cast("long"), "__salt": F.lit(0)})
    for level, dense in enumerate(found.dense):
        inside = dense.select(F.col("k").alias("__k"), *(F.col(c).alias(f"__{c}_") for c in dense.columns[1:]), F.lit(True).alias("__in"))
        on = F.col(key) == F.col("__k")
        rows = rows.join(inside, on & (F.col("__cell") == F.col("__cell_")) if level else on, "left")
        if level < len(WIDTHS):
            rows = rows.withColumn("__cell", F.when(F.col("__in"), _cell(F.col("t"), level + 1)).otherwise(F.col("__cell")))
        else:
            rows = rows.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*names), F.col("__parts_")).cast("int"), F.lit(0)))
        rows = rows.select(*names, "__cell", "__salt")
    if found.base is not None:
        base = found.base.select(F.col("k").alias(key), F.col("cell").alias("__cell"), F.col("salt").alias("__salt"), "before")
        rows = rows.join(base, [key, "__cell", "__salt"], "left").withColumn("__b", F.get("before", F.col("fold")))
    base_of = {c: F.coalesce(F.col(f"__b.{c}"), F.lit(0)) if found.base is not None else F.lit(0) for c in "ns"}
    own = [key, "__cell", "__salt"]
    return rows.select(*names, *((base_of[c] + _before(c, own, "t")).cast("long").alias(name) for c, name in (("n", n), ("s", s))))


#: Stands for a null id among keys; ids are never that small.
NO_ID = -(1 << 63)


def _shared(c: str) -> Column:
    """A text for each value and one for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _of(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): one value for each id; of several the smallest."""
    return table.select(C.whole(key), F.col(value)).where(f"{key} is not null").groupBy(key).agg(F.min(value).alias(name))


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each sale_id, item_id and vendor_id: own counts, and counts and rates of the history of its ids.

    ``lines`` (sale_id, item_id, vendor_id, flag; repeated rows count as often as they stand) meet ``sales`` (sale_id,
    client_id, sold_at) by sale_id; of several rows of one sale the earliest counts, then the one of the smallest client.
    Lines without a sale, and sales without sold_at, have no row. A null item_id or client_id is the id -1; a null
    vendor_id is a value of its own. An id without a row in its table and one with a null there share one kind,
    nation or segment; of repeated ids the smallest value counts. Rows at one microsecond are no history of each
    other. Other columns are not read; empty tables give no rows.
    """
    spark = lines.sparkSession
    scratch = C.Scratch(spark)
    minus = F.lit(-1).cast("long")
    own = lines.select(C.whole("sale_id"), F.coalesce(C.whole("item_id"), minus).alias("item_id"), C.whole("vendor_id"), F.col("flag").cast("string").alias("flag"))
    own = own.where("sale_id is not null").groupBy("sale_id", "item_id", "vendor_id")
    own = scratch.put(own.agg(F.count("*").alias("n"), F.sum(F.when(F.col("flag") == "returned", 1).otherwise(0)).cast("long").alias("s")))
    sold = sales.select(C.whole("sale_id"), micros(F.col("sold_at")).alias("t"), F.coalesce(C.whole("client_id"), minus).alias("client_id"))
    sold = sold.where("sale_id is not null and t is not null").groupBy("sale_id").agg(F.min(F.struct("t", "client_id")).alias("r"))
    sold = sold.select("sale_id", "r.*", fold_of(F.col("sale_id")).alias("fold"))
    one = own.groupBy("sale_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(sold, "sale_id")
    # written first, so that both sides of each join are plain exchanges, of which Spark splits a hot id's
    of = {key: scratch.put(_of(*about)) for key, about in (("client_id", (clients, "client_id", "segment", "segment")), ("item_id", (items, "item_id", "kind", "kind")), ("vendor_id", (vendors, "vendor_id", "nation_id", "nation")))}
    one = scratch.put(one).join(of["client_id"], "client_id", "left").withColumns({"segment": _shared("segment"), "all": F.lit("")})
    one = scratch.put(one)
    found = {key: cells(one, key, scratch, most) for key in ("all", "segment", "client_id")}
    for key, cell in found.items():
        one = history(one, key, cell, f"{key}_n", f"{key}_s")
    prior = rate(F.col("all_n"), F.col("all_s"), F.lit(PRIOR).cast("long"))
    one = one.withColumn("prior", prior).withColumn("client_prior", rate(F.col("segment_n"), F.col("segment_s"), F.col("prior")))
    one = one.select("sale_id", "t", "fold", "prior", F.col("client_id_n").alias("client_n"), rate(F.col("client_id_n"), F.col("client_id_s"), F.col("client_prior")).alias("client_rate"))
    rows = own.join(one, "sale_id")
    rows = rows.join(of["item_id"], "item_id", "left").join(of["vendor_id"], "vendor_id", "left")
    rows = scratch.put(rows.withColumns({"kind": _shared("kind"), "nation": _shared("nation"), "vendor": F.coalesce("vendor_id", F.lit(NO_ID))}))
    found = {key: cells(rows, key, scratch, most) for key in ("kind", "nation", "item_id", "vendor")}
    for key, cell in found.items():
        rows = history(rows, key, cell, f"{key}_n", f"{key}_s")
    rows = rows.withColumns({"item_prior": rate(F.col("kind_n"), F.col("kind_s"), F.col("prior")), "vendor_prior": rate(F.col("nation_n"), F.col("nation_s"), F.col("prior"))})
    return rows.select(
        "sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"),
        F.col("item_id_n").alias("item_n"), rate(F.col("item_id_n"), F.col("item_id_s"), F.col("item_prior")).alias("item_rate"),
        "vendor_n", rate(F.col("vendor_n"), F.col("vendor_s"), F.col("vendor_prior")).alias("vendor_rate"),
        "client_n", "client_rate",
    )


def op12_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's own counts and the history of its ids."""
    return encode(*(C.table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def _history_sql(key: str, name: str) -> str:
    frame = "range between unbounded preceding and 1 preceding"
    every, own = f"over (partition by {key} order by t {frame})", f"over (partition by {key}, fold order by t {frame})"
    return ", ".join(f"(coalesce(sum({c}) {every}, 0) - coalesce(sum({c}) {own}, 0))::bigint as {name}_{c}" for c in "ns")


def _rate_sql(name: str, prior: str) -> str:
    return f"case when {name}_n < 1 then {prior} else (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) end"


#: CRC-32 in SQL: the table of the reflected polynomial by rule, then a fold over the digits.
_CRC = """(list_reduce([4294967295::bigint] || list_transform(string_split(sale_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))"""

SQL = f"""
with recursive steps(i, v, k) as (
    select i, i, 0 from range(256) r(i) union all
    select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end, k + 1 from steps where k < 8),
tab as (select list(v order by i) as crc from steps where k = 8),
sold as (select sale_id, epoch_us(sold_at) as t, coalesce(client_id, -1) as client_id, (xor({_CRC}, 4294967295) % 5) as fold
    from sales, tab where sale_id is not null and sold_at is not null),
own as (select sale_id, coalesce(item_id, -1) as item_id, vendor_id, count(*) as n, count(*) filter (flag = 'returned') as s
    from sale_lines group by all),
rows as (select own.*, t, client_id, fold, kind, vendors.nation_id, segment from own join sold using (sale_id)
    left join items using (item_id) left join vendors using (vendor_id) left join clients using (client_id)),
past as (select *, {_history_sql("1", "a")}, {_history_sql("kind", "k")}, {_history_sql("nation_id", "o")}, {_history_sql("segment", "g")},
    {_history_sql("item_id", "item")}, {_history_sql("vendor_id", "vendor")}, {_history_sql("client_id", "client")} from rows),
p as (select *, {_rate_sql("a", "500000")} as pa from past),
q as (select *, {_rate_sql("k", "pa")} as pk, {_rate_sql("o", "pa")} as po, {_rate_sql("g", "pa")} as pg from p)
select sale_id, item_id, vendor_id, n as n_lines, s as n_returned, item_n, ({_rate_sql("item", "pk")})::bigint as item_rate,
    vendor_n, ({_rate_sql("vendor", "po")})::bigint as vendor_rate, client_n, ({_rate_sql("client", "pg")})::bigint as client_rate from q
"""
