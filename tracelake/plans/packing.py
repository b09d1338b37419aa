"""Span rows packed for a shuffle.

A span row is wide: its maps have an offset for each key and value, which the shuffle's codec hardly shortens.
Packed, a map is two texts, its keys and its values. ``unpack`` gives the same rows again, keys in the same order.
Folded, all texts of a packed row are one, empty arrays and a time that the nanoseconds tell are left out, and a task sends rows of like
texts next to each other: the shuffle's codec then finds their repeats. ``unfold`` gives the packed rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_MAP = "map<string,string>"
_SEP = "\x1f"

#: Between the texts of a folded row; a text that is null.
_CUT, _NONE = "\x1e", "\x1d"

#: Packed rows that one task sorts: a few hundred MB, so that the sort stays in memory.
ROWS_PER_TASK = 400_000

#: Keys that are drawn for each range.
KEYS_PER_RANGE = 200


def pack_map(m: Column) -> Column:
    """Keys and values as texts; a map that they can't tell (empty, a null value, the separator in a text) stays a map."""
    keys, values = (F.array_join(part, _SEP, _SEP) for part in (F.map_keys(m), F.map_values(m)))
    cuts = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(_SEP), F.lit("")))
    plain = (cuts(keys) == F.size(m) - 1) & (cuts(values) == F.size(m) - 1)
    return F.struct(F.when(plain, keys).alias("keys"), F.when(plain, values).alias("values"), F.when(~plain, m).alias("map"))


def unpack_map(p: Column) -> Column:
    return F.when(p["keys"].isNotNull(), F.map_from_arrays(F.split(p["keys"], _SEP), F.split(p["values"], _SEP))).otherwise(p["map"])


#: Ids of a span, and the bytes of an id whose text is lower-case hex: a trace's, any other.
_IDS = ("TraceId", "SpanId", "ParentSpanId")
_ID_BYTES = {"TraceId": 16, "_t": 16}


def pack_id(name: str, of: str | None = None) -> Column:
    """An id as bytes, half as long where its text is hex of the usual length. Other texts keep their bytes, with one more in
    front from that length on, so that no two ids become the same."""
    n, c = _ID_BYTES.get(of or name, 8), F.col(name)
    raw = c.cast("binary")
    return (F.when((F.octet_length(c) == 2 * n) & c.rlike(f"^[0-9a-f]{{{2 * n}}}$"), F.unhex(c))
            .when(F.octet_length(c) < n, raw).otherwise(F.concat(F.lit(b"x"), raw)))


def unpack_id(name: str, of: str | None = None) -> Column:
    return _id_text(F.col(name), _ID_BYTES.get(of or name, 8))


def _id_text(c: Column, n: int) -> Column:
    return (F.when(F.octet_length(c) == n, F.lower(F.hex(c))).when(F.octet_length(c) < n, c.cast("string"))
            .otherwise(F.substring(c, 2, 1 << 30).cast("string")))


def _maps(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == _MAP]


def _ids(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c in _IDS and t == "string"]


def pack(df: DataFrame, ids: bool = False) -> DataFrame:
    """``df`` with its maps (and its ids) packed, in columns of the same names. Packed hex ids sort as their texts do."""
    return df.withColumns({c: pack_map(F.col(f"`{c}`")) for c in _maps(df)} | {c: pack_id(c) for c in _ids(df) if ids})


def unpack(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``packed`` as they were in ``like``."""
    types = dict(packed.dtypes)
    return packed.withColumns({c: unpack_map(F.col(f"`{c}`")) for c in _maps(like) if c in types}
                              | {c: unpack_id(c) for c in _ids(like) if types.get(c) == "binary"})


def _time() -> Column:
    return F.timestamp_micros(F.call_function("div", F.col("StartUnixNano"), F.lit(1000)))


def _folds(df: DataFrame) -> tuple[list[str], list[str], list[str], bool]:
    """The texts, maps and arrays of ``df`` that are folded, and whether its time is."""
    types = dict(df.dtypes)
    texts = [c for c, t in df.dtypes if t == "string" and c not in _IDS]
    arrays = [c for c, t in df.dtypes if t.startswith("array<")]
    return texts, _maps(df), arrays, (types.get("Timestamp"), types.get("StartUnixNano")) == ("timestamp", "bigint")


def fold(packed: DataFrame, df: DataFrame) -> DataFrame:
    """The rows of ``packed`` (``pack(df, ids=True)``, and further columns that aren't texts) with their texts in one, ``_texts`` (``_parts``,
    where they hold the marks between them). Rows of a task that are alike follow each other."""
    texts, maps, arrays, time = _folds(df)
    col = lambda c: F.col(f"`{c}`")
    parts = [col(c) for c in texts] + [col(c)[p] for c in maps for p in ("keys", "values")]
    kept = {c: F.when(~F.coalesce(F.size(col(c)) == 0, F.lit(False)), F.struct(col(c).alias("of"))) for c in arrays}
    if time:
        kept["Timestamp"] = F.when(~F.col("Timestamp").eqNullSafe(_time()), F.struct(F.col("Timestamp").alias("of")))
    out = packed.withColumns(kept)
    if not parts:
        return out
    marked = [x for part in parts for x in (F.lit(_CUT), F.coalesce(part, F.lit(_NONE)))]
    like = F.xxhash64(*map(col, texts), *(col(c)["keys"] for c in maps))  # of rows that differ in their maps' values alone
    out = out.withColumns({"_texts": F.concat(*marked[1:]), "_nulls": sum((part.isNull().cast("int") for part in parts), F.lit(0)), "_like": like})
    count = lambda mark: F.octet_length("_texts") - F.octet_length(F.replace("_texts", F.lit(mark), F.lit("")))
    told = (count(_CUT) == len(parts) - 1) & (count(_NONE) == F.col("_nulls"))
    out = out.withColumns({"_parts": F.when(~told, F.array(*parts))}).withColumns({c: col(c)["map"] for c in maps})
    out = out.withColumn("_texts", F.when(F.col("_parts").isNull(), F.col("_texts"))).drop("_nulls", *texts)
    return out.sortWithinPartitions("_like").drop("_like")


def unfold(folded: DataFrame, df: DataFrame) -> DataFrame:
    """The packed rows that were folded: columns of ``df``, then further ones."""
    texts, maps, arrays, time = _folds(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    col = lambda c: F.col(f"`{c}`")
    kept = {c: F.when(col(c).isNull(), F.array().cast(types[c])).otherwise(col(c)["of"]) for c in arrays}
    if time:
        kept["Timestamp"] = F.when(F.col("Timestamp").isNull(), _time()).otherwise(F.col("Timestamp")["of"])
    out = folded.withColumns(kept)
    if texts or maps:
        out = out.withColumn("_parts", F.coalesce(F.split("_texts", _CUT), F.col("_parts")))
        at = lambda i: F.get("_parts", F.lit(i))
        part = lambda i: F.when(F.col("_texts").isNull() | (at(i) != _NONE), at(i))
        n = len(texts)
        out = out.withColumns({c: part(i) for i, c in enumerate(texts)} | {c: F.struct(
            part(n + 2 * i).alias("keys"), part(n + 2 * i + 1).alias("values"), col(c).alias("map")) for i, c in enumerate(maps)})
    return out.select(*map(col, df.columns), *(col(c) for c in folded.columns if c not in (*df.columns, "_texts", "_parts")))


def unpack_structs(structs: Column, like: DataFrame, fields: list[str], ids: bool = False) -> Column:
    """An array of structs of packed ``fields`` (``ids`` too, if they were) with the values that ``like`` had."""
    maps, hexed = _maps(like), _ids(like) if ids else []
    of = lambda s, f: unpack_map(s[f]) if f in maps else _id_text(s[f], _ID_BYTES.get(f, 8)) if f in hexed else s[f]
    return F.transform(structs, lambda s: F.struct(*[of(s, f).alias(f) for f in fields]))


#: A task of a job that writes rows makes them from so many bytes of a shuffle, so that it can sort what it sends.
MADE_FROM = "8m"


_ELIMINATE_SORTS = "org.apache.spark.sql.catalyst.optimizer.EliminateSorts"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside of the block delete their shuffle files when they end; their tasks are small and keep the sorts of ``fold``."""
    given = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": MADE_FROM,
             "spark.sql.optimizer.excludedRules": ",".join(filter(None, [spark.conf.get("spark.sql.optimizer.excludedRules", None), _ELIMINATE_SORTS]))}
    before = {name: spark.conf.get(name, None) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _cuts(keys: DataFrame, n: int, rows: int) -> list[Row]:
    """``n - 1`` keys in order that cut ``keys`` into ``n`` ranges of about as many rows, by a sample of them."""
    wanted = KEYS_PER_RANGE * n
    some = keys if rows <= wanted else keys.sample(wanted / rows, seed=7)
    key = some.agg(F.sort_array(F.collect_list(F.struct(*keys.columns))).alias("k"))
    place = lambda i: F.call_function("div", i * F.size("k"), F.lit(n)).cast("int")  # noqa: E731  i is a bigint: thousands of ranges overflow an int
    at = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda i: F.get("k", place(i)))
    return [c for c in key.select(at).first()[0] if c is not None]


def range_no(df: DataFrame, cols: list[str], n: int, rows: int) -> Column:
    """The number (0 to ``n - 1``) of each row's range of ``cols``. Ranges are drawn from the key columns alone, so that
    wide rows are made once; equal keys have the same range."""
    keys = df.select(*cols)
    if n == 1 or not (cuts := _cuts(keys, n, rows)):
        return F.lit(0)
    literal = lambda cut: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, keys.schema)))
    return place_among(F.struct(*cols), F.array(*map(literal, cuts)), len(cuts))


def place_among(key: Column, cuts: Column, n: int) -> Column:
    """How many of the ``n`` ordered ``cuts`` don't lie above the key, by binary search."""
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    below = lambda key: F.aggregate(
        halves, F.lit(0), lambda at, half: F.when(F.get(cuts, at + half - 1) <= key, at + half).otherwise(at))
    return F.get(F.transform(F.array(key), below), F.lit(0))


def deal_sorted(df: DataFrame, n: int | None, ranges: list[str], order: list[str], rows_per_task: int | None = None) -> DataFrame:
    """``df`` dealt into ranges of ``ranges`` (``n`` at least) and sorted within by ``order``; rows travel folded. A task gets
    ``rows_per_task`` rows or so (``ROWS_PER_TASK``): larger inputs have more ranges, not larger sorts."""
    packed = pack(df, ids=True)
    with dropped_shuffles(df.sparkSession):  # those of the passes before the rows travel
        rows = df.count()
        tasks = max(n or 1, ceil(rows / (rows_per_task or ROWS_PER_TASK)))
        number = range_no(packed, ranges, tasks, rows)
    dealt = fold(packed.withColumn("_range", number), df).repartitionById(tasks, "_range").drop("_range")
    return unpack(unfold(dealt, df).sortWithinPartitions(*order), df)
