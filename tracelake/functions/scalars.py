"""Scalar column expressions for span tables (all JVM-side, codegen friendly).

Keyed hash draws replace a random stream: a draw is a slice of an md5 hex
digest of a stable key, so the value does not depend on partitioning, task
retries or the engine (DuckDB reproduces it with ``('0x'||substr(h,p,15))::BIGINT``
and the same shifts and masks). Hex parsing (``conv``) is the costly part, so
a digest is parsed once (``hex60``) and cut into several draws (``bits``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pools

NS_PER_SECOND = 1_000_000_000
NS_PER_MICRO = 1_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column | str, b: Column | str | int) -> Column:
    """Integer division (SQL ``div``): exact on BIGINT nanoseconds."""
    return F.call_function("div", col(a), F.lit(b) if isinstance(b, int) else col(b))


def hex_draw(h: Column | str, pos: int, width: int = 4) -> Column:
    """Unsigned integer from ``width`` hex digits of digest ``h`` at 1-based ``pos``."""
    kind = "int" if width <= 7 else "bigint"
    return F.conv(F.substring(col(h), pos, width), 16, 10).cast(kind)


def hex60(h: Column | str, pos: int) -> Column:
    """60-bit integer from 15 hex digits of digest ``h`` at 1-based ``pos``:
    one parse per digest, from which several draws are cut by ``bits``."""
    return F.conv(F.substring(col(h), pos, 15), 16, 10).cast("bigint")


def bits(x: Column | str, shift: int, mask: int = 0xFFFF) -> Column:
    """A draw of ``mask`` width taken ``shift`` bits up from integer ``x``."""
    return F.shiftright(col(x), shift).bitwiseAND(F.lit(mask)) if shift else col(x).bitwiseAND(F.lit(mask))


def draw_uniform(key: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits (52 bits) of md5(key)."""
    return hex_draw(F.md5(col(key).cast("string")), 1, 13) / F.lit(float(1 << 52))


def pick(pool: Sequence, draw: Column) -> Column:
    """Uniform choice from a literal pool by a non-negative integer draw.

    Weighted choice is the same call with repeated entries (e.g. 200 three
    times among six status codes).
    """
    return F.element_at(F.array(*[F.lit(v) for v in pool]), (F.pmod(draw, F.lit(len(pool))) + 1).cast("int"))


def sample_lognormal(mu: Column | float, sigma: Column | float, key: Column | str) -> Column:
    """exp(mu + sigma * N) nanoseconds floored at 1 µs; N by Box-Muller on two keyed draws."""
    u1 = F.greatest(draw_uniform(F.concat(col(key).cast("string"), F.lit(":u1"))), F.lit(1e-300))
    u2 = draw_uniform(F.concat(col(key).cast("string"), F.lit(":u2")))
    normal = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
    mu_c = F.lit(mu) if isinstance(mu, (int, float)) else mu
    sigma_c = F.lit(sigma) if isinstance(sigma, (int, float)) else sigma
    return F.greatest(F.lit(1000), F.floor(F.exp(mu_c + sigma_c * normal)).cast("bigint"))


def hex_id(digest: Column | str, n_hex: int) -> Column:
    """Lower-hex id of ``n_hex`` digits; '' when the id is all zeros (empty id)."""
    h = F.lower(F.substring(col(digest), 1, n_hex))
    return F.when(h == F.lit("0" * n_hex), F.lit("")).otherwise(h)


def duration_ns(start_ns: Column | str, end_ns: Column | str) -> Column:
    return col(end_ns) - col(start_ns)


def ts_from_ns(ns: Column | str) -> Column:
    """TIMESTAMP (µs) from BIGINT epoch nanoseconds (truncating)."""
    return F.timestamp_micros(idiv(ns, NS_PER_MICRO))


def start_of_minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", col(ts))


def start_of_hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", col(ts))


def to_day(ts: Column | str) -> Column:
    return F.to_date(col(ts))


def to_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(col(ts))


def ntz(ts: Column | str) -> Column:
    """Wall-clock TIMESTAMP_NTZ of a UTC timestamp (for engine-neutral output)."""
    return col(ts).cast("timestamp_ntz")


def readable_size(nbytes: Column | str) -> Column:
    """Human readable byte size with binary units, two decimals: '1.50 KiB'."""
    b = col(nbytes).cast("double")
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    expr = None
    for i in range(len(units) - 1, 0, -1):
        cond = b >= F.lit(float(1024 ** i))
        val = F.concat(F.format_string("%.2f", b / F.lit(float(1024 ** i))), F.lit(" " + units[i]))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.concat(F.format_string("%.2f", b), F.lit(" B")))


def shard_of(trace_id: Column | str, n: int, method: str = "md5prefix") -> Column:
    """Shard index of a trace: uniform over shards, and every span of a trace
    lands on the same shard. ``xxhash64`` is the production choice;
    ``md5prefix`` (first 8 hex digits of the already-random TraceId) is
    reproducible in DuckDB for the oracle checks."""
    if method == "xxhash64":
        return F.pmod(F.xxhash64(col(trace_id)), F.lit(n)).cast("int")
    return F.pmod(F.conv(F.substring(col(trace_id), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def service_name_of(idx: Column | str) -> Column:
    """Pool name cycling, with a '-k' suffix once the pool is exhausted."""
    n = len(pools.SERVICE_NAMES)
    base = pick(pools.SERVICE_NAMES, col(idx))
    return F.when(col(idx) >= n, F.concat(base, F.lit("-"), idiv(idx, n).cast("string"))).otherwise(base)


def db_port(system: Column | str) -> Column:
    expr = None
    for name, port in pools.DB_PORTS.items():
        cond = col(system) == F.lit(name)
        expr = F.when(cond, F.lit(port)) if expr is None else expr.when(cond, F.lit(port))
    return expr.otherwise(F.lit(0))


def msg_operation(op_type: Column | str) -> Column:
    return F.when(col(op_type) == F.lit("msg_producer"), F.lit("publish")).otherwise(F.lit("process"))


def peer_host(route: Column | str) -> Column:
    return F.when(F.coalesce(col(route), F.lit("")) != F.lit(""), F.lit(pools.PEER_HOST)).otherwise(F.lit("localhost"))


def client_ip(d1: Column, d2: Column, d3: Column) -> Column:
    return F.concat_ws(".", F.lit("10"), F.pmod(d1, F.lit(4)).cast("string"),
                       F.pmod(d2, F.lit(256)).cast("string"), F.pmod(d3, F.lit(256)).cast("string"))


def query_text(db_op: Column | str, collection: Column | str) -> Column:
    return F.concat(col(db_op), F.lit(" FROM "), col(collection), F.lit(" WHERE id = ?"))


def canonical_json(m: Column | str) -> Column:
    """Compact JSON object text with sorted keys; '{}' when empty or NULL."""
    sorted_map = F.map_from_entries(F.sort_array(F.map_entries(col(m))))
    return F.coalesce(F.when(F.size(col(m)) > 0, F.to_json(sorted_map)), F.lit("{}"))


def attrs_to_strings(m: Column | str) -> Column:
    """map<string, any> → map<string, string> (ints as decimal text, bools true/false)."""
    return F.transform_values(col(m), lambda _k, v: v.cast("string"))


def row_digest(*cols: Column | str) -> Column:
    """SHA-256 (32 bytes) of a row's values as text, each with its byte count before it ('-' for null):
    rows are equal if their digests are."""
    def part(c):
        text = col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in cols]), 256))
