"""Packing documents into token sequences: a configuration linear program over the histogram of lengths.

Documents are cut into pieces of at most the capacity; pieces of the same length are alike, so a packing is a list of
configurations (how many pieces of each length a sequence holds) with multiplicities. The linear program over
configurations is solved by multiplicative weights, whose oracle is a knapsack by dynamic programming, and rounded down;
what rounding leaves is packed best-fit. The driver sees the histogram only, never a row for each document.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import fresh, n_buckets, running, written

CAPACITY = 2048
#: Rounds of multiplicative weights, the step of the weights, how far under the best value a configuration may be, and how
#: many pieces are no longer worth a program.
ROUNDS, STEP, SLACK, FEW = 100, 0.3, 0.005, 64
#: A table packed in its own order is packed window by window: at least and at most so many sequences, and so many windows between.
LEAST_WINDOW, MOST_WINDOW, WINDOWS = 256, 8192, 8

#: Where a row lies in the files of its table: the number of the file, times ROWS_A_FILE, and of the row in it.
AT, ROWS_A_FILE = "_at", 2**40

_state: dict = {}


def encoder(ranks_path: str, pattern: str, specials: Mapping[str, int] | None = None):
    """A function from text to token ids as little-endian unsigned 32-bit bytes, for byte-level BPE.

    ranks_path is a file of base64 tokens and ranks; pattern splits pre-tokens; specials are strings that are one id
    wherever they come in a text. A worker reads the file once.
    """
    specials = dict(specials or {})
    if _state.get("key") != (ranks_path, pattern, specials):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _state.update(key=(ranks_path, pattern, specials), bpe=tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials))
    bpe = _state["bpe"]
    return lambda text: np.array(bpe.encode(text, allowed_special="all"), "<u4").tobytes()


def pieces(docs: DataFrame, ranks_path: str, pattern: str, specials: Mapping[str, int] | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): the pieces of each document's ids with the end id after them.

    Only a document of more than the capacity is cut: the first piece takes the remainder, all others are full. A column
    AT, as in_file_order gives it, is kept.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path, pattern, specials)
        for b in batches:
            out: list[tuple] = []
            for doc, text, *more in zip(*(b[c] for c in b.columns), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    out.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), *more))
                    at, k = at + size, k + 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", *keep]).astype({"id": b["id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    keep = [c for c in docs.columns if c == AT]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    return rows.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + "".join(f", {c} long" for c in keep))


def best_configs(values: np.ndarray, capacity: int, slack: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Knapsack by dynamic programming: configurations (sizes, counts) of the largest total value, or nearly.

    values[s] is the value of a piece of size s, 0 for sizes that there are none of. One table gives, for every size, the
    best configuration that holds it; those within slack of the best of all come out, the best one first.
    """
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        got = best[c - 1 :: -1] + values[1 : c + 1]  # got[s - 1]: a piece of size s, then the best of the rest
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], pick[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    sizes = np.flatnonzero(values > 0)
    held = values[sizes] + best[capacity - sizes]
    out, done = [], set()
    for s in sizes[np.argsort(-held, kind="stable")].tolist():
        if values[s] + best[capacity - s] < (1 - slack) * best[capacity]:
            break
        if s in done:
            continue
        config, c = {s: 1}, capacity - s
        while c > 0:
            k = int(pick[c])
            if k:
                config[k] = config.get(k, 0) + 1
            c -= k or 1
        done.update(config)
        out.append((np.array(sorted(config)), np.array([config[k] for k in sorted(config)])))
    return out


def fractional(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, slack: float = SLACK) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """A solution of the covering program, min sum x subject to sum x_c c >= demand, as (sizes, counts, x).

    demand[s] is the number of pieces of size s. Weights begin with the tokens of each size. A round prices sizes by their
    weights, finds the most valuable configurations, takes as much of each as covers one of its sizes whole, and lowers the
    weights of what these cover. The rounds together cover the tokens some times over, and are scaled to cover them once;
    with more rounds all sizes come to be covered alike.
    """
    sizes = np.flatnonzero(demand)
    covered, seen = np.zeros(capacity + 1), {}
    scale = np.zeros(capacity + 1)
    scale[sizes] = sizes / capacity
    for _ in range(rounds):
        least = covered[sizes].min()
        values = scale * np.exp(-step * (covered - least))
        values[sizes] = np.maximum(values[sizes], 1e-300)
        for own, n in best_configs(values, capacity, slack):
            n = np.minimum(n, demand[own])
            x = float((demand[own] / n).min())
            key = (own.tobytes(), n.tobytes())
            seen[key] = (own, n, seen[key][2] + x if key in seen else x)
            covered[own] += n * x / demand[own]
    times = float(covered[sizes] @ (sizes * demand[sizes]) / (sizes @ demand[sizes]))
    return [(own, n, x / times) for own, n, x in seen.values()]


def fit_left(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing of what is left of each size, sequences of the same content together."""
    left, out = left.copy(), []
    while left.any():
        room, config = capacity, {}
        open_ = np.flatnonzero(left)
        while len(open_):
            s = int(open_[-1])
            n = min(int(left[s]), room // s)
            config[s] = n
            room -= n * s
            open_ = open_[: np.searchsorted(open_, min(room, s - 1), side="right")]
        times = min(int(left[s]) // n for s, n in config.items())
        for s, n in config.items():
            left[s] -= n * times
        out.append((config, times))
    return out


def rounded(found: list[tuple[np.ndarray, np.ndarray, float]], left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Whole multiplicities of the fractional solution, largest first, as far as the pieces last; left loses them.

    First the whole parts of x, then one more sequence for each fraction whose configuration is as full as they are on average.
    """
    out: dict[tuple, tuple[dict[int, int], int]] = {}
    found = sorted(found, key=lambda f: (-f[2], f[0].tolist(), f[1].tolist()))
    mean = sum(float(own @ n) * x for own, n, x in found) / sum(x for _, _, x in found)
    for wanted in (lambda x, tokens: int(x), lambda x, tokens: int(tokens >= mean)):
        for own, n, x in found:
            times = min(wanted(x, own @ n), int((left[own] // n).min()))
            if times > 0:
                left[own] -= times * n
                key = (own.tobytes(), n.tobytes())
                out[key] = (dict(zip(own.tolist(), n.tolist(), strict=True)), out.get(key, (None, 0))[1] + times)
    return list(out.values())


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: pieces} with multiplicities that hold exactly the pieces of the histogram.

    The program is solved and rounded; what rounding leaves is a smaller program of the same kind, until the next one would
    place less than a tenth of its pieces or few are left. Those few are packed best-fit, together with the pieces of
    configurations that have more room than some bound: the largest bound that needs the fewest sequences.
    """
    full = histogram.get(capacity, 0)
    out: list[tuple[dict[int, int], int]] = [({capacity: 1}, full)] if full else []
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        if s < capacity:
            left[s] = n
    chosen: list[tuple[dict[int, int], int]] = []
    while left.sum() > FEW:
        before = int(left.sum())
        chosen += rounded(fractional(left, capacity, rounds), left)
        if int(left.sum()) > before * 9 // 10:
            break
    ways = []
    for room in (capacity, *(capacity >> k for k in range(3, 12)), 0):
        open_ = [capacity - sum(s * k for s, k in c.items()) > room for c, _ in chosen]
        again = left.copy()
        for (c, n), o in zip(chosen, open_, strict=True):
            for s, k in c.items():
                again[s] += k * n * o
        ways.append([c for c, o in zip(chosen, open_, strict=True) if not o] + fit_left(again, capacity))
    return out + min(ways, key=lambda way: sum(n for _, n in way))


def places(configs: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, first, until, sequence, each, offset): pieces first..until - 1 of the size go to the configuration's
    sequences from sequence on, each in one, from offset on."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for config, times in configs:
        offset = 0
        for size in sorted(config, reverse=True):
            n = config[size]
            first = taken.get(size, 0)
            taken[size] = first + n * times
            out.append((size, first, first + n * times, sequence, n, offset))
            offset += n * size
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, id_col: str = "id") -> DataFrame:
    """The rows of cut, a written table with lengths from 1 to the capacity, with sequence_id and offset.

    Pieces of one length are numbered bucket by bucket and looked up in the places of the plan, which has a row for each
    size of each configuration: capacity times ROUNDS at most, however many pieces there are.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = cut.sparkSession.createDataFrame(places(plan(histogram, capacity, rounds)), "size long, first long, until long, seq long, each long, base long")
    buckets = n_buckets(max(histogram.values(), default=0))
    rows = running(cut, ["length"], F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)), [F.col(id_col), F.col("piece"), F.col("row")], None, "_rank")
    rows = rows.join(F.broadcast(table), (F.col("length") == F.col("size")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("until")))
    inside = F.col("_rank") - F.col("first")
    return rows.select(
        *[c for c in cut.columns if c != "row"],
        (F.col("seq") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(inside, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def spread(configs: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """(length, rank, sequence, offset): the place of each piece, with the sequences of every configuration spread evenly.

    Sequences take the pieces of a length in the order of their ranks, so pieces at the same share of their lengths' ranks
    come together.
    """
    times = [t for _, t in configs]
    which = np.repeat(np.arange(len(times)), times)
    turn = np.concatenate([(np.arange(t) + 0.5) / t for t in times])
    number = np.empty(len(which), np.int64)
    number[np.lexsort((which, turn))] = np.arange(len(which))
    parts, first = [], 0
    for config, t in configs:
        own, base = number[first : first + t], 0
        for size in sorted(config, reverse=True):
            n = config[size]
            parts.append((np.full(n * t, size, np.int64), np.repeat(own, n), np.tile(base + size * np.arange(n, dtype=np.int64), t)))
            base += n * size
        first += t
    out = pd.DataFrame(dict(zip(("length", "sequence", "offset"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
    out = out.sort_values(["length", "sequence", "offset"])
    out["rank"] = out.groupby("length").cumcount()
    return out[["length", "rank", "sequence", "offset"]]


def in_file_order(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of docs, as read from files, with the column AT that orders rows as they were written."""
    path, line, file = fresh(docs, "_path", "_line", "_file")
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], meta["file_path"].alias(path), meta["row_index"].alias(line))
    paths = sorted((r[path] for r in rows.select(path).distinct().collect()), key=lambda p: (len(p), p))
    table = docs.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], f"{path} string, {file} long")
    rows = rows.join(F.broadcast(table), path)
    return rows.select(*[F.col(f"`{c}`") for c in columns], (F.col(file) * ROWS_A_FILE + F.col(line)).alias(AT))


def pack_in_order(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, window: int | None = None) -> DataFrame:
    """The rows of cut, a written table with AT, with sequence_id and offset; sequences follow the order of AT.

    The order is cut into windows of so many sequences' tokens. Each is packed on its own, by its own plan, and the
    sequences of a window come after those of the windows before; in a window pieces of one length are taken in order and
    the configurations are spread evenly. So no piece leaves its window, however lengths change along the table. Plans are
    made by tasks, one a window; the driver sees a number for each window.
    """
    spark = cut.sparkSession
    total = cut.agg(F.sum("length").alias("n")).first()["n"] or 0
    span = capacity * (window or max(LEAST_WINDOW, min(MOST_WINDOW, total // capacity // WINDOWS)))
    rows = running(cut, [], F.shiftright(AT, 10), [F.col(AT), F.col("piece")], F.col("length"), "_start_token")
    rows = written(rows.withColumn("_window", F.floor(F.col("_start_token") / span).cast("long")), "windows")
    histogram = written(rows.groupBy("_window", "length").agg(F.count("*").alias("n")), "histogram")
    buckets = n_buckets(histogram.agg(F.max("n").alias("n")).first()["n"] or 0)

    def lay(part: pd.DataFrame) -> pd.DataFrame:
        out = spread(plan({int(s): int(n) for s, n in zip(part["length"], part["n"], strict=True)}, capacity, rounds))
        out.insert(0, "_window", part["_window"].iloc[0])
        return out

    # a number of partitions that is asked for isn't merged: small tables, but each window's plan takes seconds
    laid = histogram.repartition(max(1, total // span + 1), "_window").groupBy("_window").applyInPandas(lay, "_window long, length long, rank long, sequence long, offset long")
    laid = written(laid, "laid")
    held = sorted((r["_window"], r["n"]) for r in laid.groupBy("_window").agg((F.max("sequence") + 1).alias("n")).collect())
    firsts, first = [], 0
    for w, n in held:
        firsts.append((w, first))
        first += n
    table = spark.createDataFrame(firsts, "_window long, _first long")
    bucket = F.floor(F.pmod("_start_token", F.lit(span)) * buckets / span)
    rows = running(rows, ["_window", "length"], bucket, [F.col(AT), F.col("piece")], None, "rank")
    rows = rows.join(laid, ["_window", "length", "rank"]).join(F.broadcast(table), "_window")
    return rows.select(*[c for c in cut.columns if c != AT], (F.col("_first") + F.col("sequence")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, ranks_path: str, pattern: str, specials: Mapping[str, int] | None = None, capacity: int = CAPACITY, end_id: int = 0, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False, window: int | None = None) -> DataFrame:
    """One row per piece of docs: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    A null text is empty: one piece of the end id alone. Equal rows are packed as often as they come. An empty table gives
    an empty result. Other columns of docs play no part. With in_order, docs must be read from files as they are, and
    sequence_id follows the order in which their rows were written.
    """
    if in_order:
        cut = written(pieces(in_file_order(docs, id_col, text_col), ranks_path, pattern, specials, capacity, end_id, id_col, text_col), "pieces")
        return pack_in_order(cut, capacity, rounds, window).withColumnRenamed("id", id_col)
    cut = pieces(docs, ranks_path, pattern, specials, capacity, end_id, id_col, text_col)
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(cut, capacity, rounds).withColumnRenamed("id", id_col)
