"""Documents that share most of their word n-grams, by a blocked sparse matrix product.

The incidence matrix has a row for each distinct n-gram set and a column for each n-gram. Its
product with its own transpose holds the overlap counts. Only the cells that can reach the bound
are worked out:

1. Equal sets are one row. A class is the documents of one set; links inside it are certain.
2. A row of size ``n`` that reaches ``similarity`` with any other row shares a column of its first
   ``n - ceil(similarity * n) + 1`` columns with it, in any order of the columns that all rows keep to. Here
   rare columns come first. The order changes how much work there is, never the result.
3. Columns are dealt by hash into blocks; a block multiplies its columns and adds up overlap counts by pair of
   rows. In a cell of a column, a pair is left out if it could not reach the bound even if this were the first
   column that its rows share: where it is the first, that is exact, and elsewhere the pair is met
   earlier. Counts of one pair from all blocks are summed, and pairs that still cannot reach the
   bound are dropped before the whole rows are compared.
4. Groups of near copies would fill the product with links that say nothing new. So each row is first
   compared with the leaders of a few min-hash groups, and cells between rows that are already
   connected are left out of the product. All others are compared, so no component is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import gives_back, utf8
from shardloom.llm.components import connected_components
from shardloom.llm.shingles import in_slices, mix, shingle_sets
from shardloom.session import broadcast_if_small, materialize

WIDTH, SIMILARITY_PCT = 5, 80
# Min-hash groups whose leaders every row is compared with.
LEADERS = 3
# Columns that are ordered last: the most frequent ones that single tasks have seen repeatedly. 8 bytes each.
FREQUENT = 1 << 20
# A column with more rows than the first is set aside, cut by the second, and the cuts are multiplied in pairs.
LONG, CUT = 2048, 512
# Pairs that a block holds before it passes on their counts.
HELD_PAIRS = 1 << 18
# Ids, with a component each, that one broadcast may hold; more are joined by an exchange.
BROADCAST_IDS = 1_000_000

_SALTS = mix(np.arange(1, LEADERS + 1, dtype=np.uint64))
_SIGNED = np.int64


def _needed(n: np.ndarray | int, pct: int):
    """Smallest overlap of a row of size ``n`` with any row that it links with."""
    return -(-n * pct // 100)


def _rows(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingle_sets(batch.column("bytes").to_pylist(), width)


def class_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, leaders``: size, 128-bit digest and min-hashes of each row's set."""

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _rows(batch, width)
            sums = [(int(mix(s).sum()) if len(s) else 0, int(mix(s ^ _SALTS[0]).sum()) if len(s) else 0) for s in sets]
            minima = [[int(mix(s ^ salt).min().view(_SIGNED)) for salt in _SALTS] if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([a for a, _ in sums], np.uint64).view(_SIGNED)),
                pa.array(np.array([b for _, b in sums], np.uint64).view(_SIGNED)),
                pa.array(minima, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "set_a", "set_b", "leaders"])

    return docs.select("doc_id", utf8().alias("bytes")).mapInArrow(
        scan, "doc_id long, n_shingles long, set_a long, set_b long, leaders array<long>"
    )


def _bitmap(s: np.ndarray) -> bytes:
    """Which places the items of a set fall into, of a power of two of places, at least four for an item."""
    bits = max(6, (4 * len(s)).bit_length())
    places = np.zeros(1 << bits, bool)
    places[(mix(s) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(places).tobytes()


def _most_shared(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """How many items two sets of sizes ``nx, ny`` share at the most, by their bitmaps.

    A place that only one set has holds an item that the other has not.
    """
    one, two = (np.unpackbits(np.frombuffer(v, np.uint8)).view(bool) for v in (x, y))
    size = min(len(one), len(two))
    # Places go by the first bits of a hash, so neighbours become one place of the shorter map.
    one, two = (v.reshape(size, -1).any(1) for v in (one, two))
    return min(nx - int((one & ~two).sum()), ny - int((two & ~one).sum()))


def _of_ids(docs: DataFrame, ids: DataFrame, width: int, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``id, n, items`` (size and ``form`` of the sorted 64-bit hashes) of the documents that ``ids`` (column ``id``) names."""

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _rows(batch, width)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([form(s) for s in sets], pa.binary()),
            ], names=["id", "n", "items"])

    wanted = docs.select(F.col("doc_id").alias("id"), utf8().alias("bytes")).join(
        broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi"
    )
    # Rows may repeat an id with another text; one text, the same in every attempt, stands for the id.
    return wanted.mapInArrow(scan, "id long, n long, items binary")


def frequent_columns(docs: DataFrame, width: int, most: int = FREQUENT) -> np.ndarray:
    """Hashes of at most ``most`` columns by falling number of rows, as far as tasks have seen them repeat.

    A task passes on only what it met twice, so the table stays small. A column that this misses
    is ordered among the rare ones, which costs time, not results.
    """

    @gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in in_slices(_rows(batch, width)):
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                seen = n > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[seen].view(_SIGNED)), pa.array(n[seen].astype(np.int64))], names=["c", "n"]
                )

    counted = (
        docs.select(utf8().alias("bytes")).mapInArrow(count, "c long, n long")
        .groupBy("c").agg(F.sum("n").alias("n"))
    )
    top = counted.orderBy(F.desc("n"), "c").limit(most).toArrow()
    return np.array(top.column("c").combine_chunks().to_numpy(zero_copy_only=False), _SIGNED).view(np.uint64)


def _leading(docs: DataFrame, width: int, pct: int, frequent: np.ndarray) -> DataFrame:
    """``id, n, columns``: the leading columns of each row in order, as bytes."""
    order = np.argsort(frequent, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int32)))

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            leads, sizes = [], []
            for s in _rows(batch, width):
                n = len(s)
                # Rare columns by hash, then the frequent ones from rare to frequent.
                late = np.zeros(n, np.int64)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    late[hit] = len(known) - rank[at[hit]]
                leads.append(s[np.argsort(late, kind="stable")[: n - _needed(n, pct) + 1]].tobytes() if n else b"")
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(leads, pa.binary())],
                names=["id", "n", "columns"],
            )

    return docs.select(F.col("doc_id").alias("id"), utf8().alias("bytes")).mapInArrow(
        scan, "id long, n long, columns binary"
    )


def _postings(leading: DataFrame) -> DataFrame:
    """``c, id, n, rest, comp``: each leading column of each row, and how many columns of the row follow it."""

    @gives_back
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = [np.frombuffer(x, _SIGNED) for x in batch.column("columns").to_pylist()]
            size = np.array([len(x) for x in leads], np.int64)
            ids, n, comp = (np.asarray(batch.column(k), np.int64) for k in ("id", "n", "comp"))
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(leads) if leads else np.empty(0, _SIGNED)), pa.array(np.repeat(ids, size)),
                pa.array(np.repeat(n, size)), pa.array(np.repeat(n, size) - 1 - place),
                pa.array(np.repeat(comp, size)),
            ], names=["c", "id", "n", "rest", "comp"])

    return leading.mapInArrow(spread, "c long, id long, n long, rest long, comp long")


_PAIR = "long_column boolean, a long, b long, shared long, na long, nb long, rest long"


def _candidates(postings: DataFrame, pct: int, long_rows: int) -> DataFrame:
    """``a, b``: rows of different components that share a leading column and can still reach the bound.

    A block is a task's columns, in order. A column with very many rows passes through it a
    batch at a time; then its rows are cut by a hash, and each pair of cuts is a cell of its own, so no task
    gets a whole long column.
    """

    @gives_back
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_columns(batches, long_rows):
            if isinstance(table, pa.RecordBatch):
                yield table
            else:
                yield from _product(table, pct)

    first = materialize(postings.repartition("c").sortWithinPartitions("c").mapInArrow(multiply, _PAIR), "product")
    far = first.filter("long_column").select(
        F.col("a").alias("c"), F.col("b").alias("id"), F.col("na").alias("n"), "rest", F.col("nb").alias("comp")
    )
    per_column = (
        far.groupBy("c").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo < hi").select("c", F.ceil(F.col("f") / CUT).cast("int").alias("cuts"))
    )
    mine = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    cells = far.join(materialize(per_column, "columns"), "c").withColumn("mine", mine).withColumn(
        "cell", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("cuts") - 1),
            lambda other: F.struct(F.least(other, F.col("mine")).alias("i"), F.greatest(other, F.col("mine")).alias("j")),
        ))
    )

    @gives_back
    def multiply_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            yield from _cell_products(table, pct)

    dealt = (
        cells.select("c", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "mine", "id", "n", "rest", "comp")
        .repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    )
    counts = first.filter("NOT long_column").unionByName(dealt.mapInArrow(multiply_cells, _PAIR))
    # ``rest``: what the two rows may still share after the last column they were met in.
    summed = counts.groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"), F.min("rest").alias("rest"),
    )
    reach = F.col("shared") + F.col("rest")
    return summed.filter(100 * reach >= pct * (F.col("na") + F.col("nb") - reach)).select("a", "b")


def _whole_columns(
    batches: Iterator[pa.RecordBatch], long_rows: int
) -> Iterator[dict[str, np.ndarray] | pa.RecordBatch]:
    """Sorted rows as tables of whole columns; rows of a long column as they come, marked as such."""
    held: dict[str, np.ndarray] | None = None
    going: int | None = None  # the long column that passes through
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: np.asarray(batch.column(k), np.int64) for k in ("c", "id", "n", "rest", "comp")}
        if going is not None:
            end = int(np.searchsorted(rows["c"], going, "right"))
            if end:
                yield _set_aside({k: v[:end] for k, v in rows.items()})
            if end == len(rows["c"]):
                continue
            rows, going = {k: v[end:] for k, v in rows.items()}, None
        held = rows if held is None else {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        last = int(np.searchsorted(held["c"], held["c"][-1], "left"))
        if last:
            yield {k: v[:last] for k, v in held.items()}
            held = {k: v[last:] for k, v in held.items()}
        if len(held["c"]) > long_rows:
            going = int(held["c"][0])
            yield _set_aside(held)
            held = None
    if held is not None:
        yield held


def _set_aside(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    k = len(rows["c"])
    return pa.RecordBatch.from_arrays([
        pa.array(np.ones(k, bool)), pa.array(rows["c"]), pa.array(rows["id"]), pa.array(np.zeros(k, np.int64)),
        pa.array(rows["n"]), pa.array(rows["comp"]), pa.array(rows["rest"]),
    ], names=["long_column", "a", "b", "shared", "na", "nb", "rest"])


def _product(rows: dict[str, np.ndarray], pct: int) -> Iterator[pa.RecordBatch]:
    """Overlap counts of the pairs in whole columns, some of them in several parts."""
    c, comp = rows["c"], rows["comp"]
    edges = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    mixed = np.minimum.reduceat(comp, edges) < np.maximum.reduceat(comp, edges)
    live = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[edges, len(c)])))
    c, ids, n, rest, comp = (rows[k][live] for k in ("c", "id", "n", "rest", "comp"))
    # Every row with the one 1, 2, ... places further on, as long as the column is the same.
    out, size, at, step = [], 0, np.arange(len(c)), 1
    while len(at):
        at = at[at + step < len(c)]
        at = at[c[at] == c[at + step]]
        out.append(_reaching(at, at + step, ids, n, rest, comp, pct))
        size += out[-1].shape[1]
        if size > HELD_PAIRS:
            yield _summed(out)
            out, size = [], 0
        step += 1
    yield _summed(out)


def _reaching(x, y, ids, n, rest, comp, pct: int) -> np.ndarray:
    """Pairs of places as rows of ids, sizes and rests, without those that cannot reach the bound here."""
    least = np.minimum(rest[x], rest[y])
    keep = (comp[x] != comp[y]) & (ids[x] != ids[y])
    keep &= 100 * np.minimum(n[x], n[y]) >= pct * np.maximum(n[x], n[y])
    keep &= 100 * (1 + least) >= pct * (n[x] + n[y] - 1 - least)
    x, y, least = x[keep], y[keep], least[keep]
    swap = ids[x] > ids[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return np.stack([ids[x], ids[y], np.ones(len(x), np.int64), n[x], n[y], least])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole cells of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k), np.int64) for k in ("c", "i", "j")])
        cut = np.flatnonzero((keys[:, -1:] != keys).any(0))
        last = int(cut[-1]) + 1 if len(cut) else 0
        if last == 0 and held:
            before = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in ("c", "i", "j")]
            if before != keys[:, 0].tolist():
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _cell_products(table: pa.Table, pct: int) -> Iterator[pa.RecordBatch]:
    c, i, j, mine, ids, n, rest, comp = (
        np.asarray(table.column(k).combine_chunks(), np.int64)
        for k in ("c", "i", "j", "mine", "id", "n", "rest", "comp")
    )
    starts = np.r_[0, np.flatnonzero((np.diff(c) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1, len(c)]
    out, size = [np.empty((6, 0), np.int64)], 0
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if i[lo] == j[lo]:
            x, y = np.triu_indices(hi - lo, 1)
        else:
            left, right = np.flatnonzero(mine[lo:hi] == i[lo]), np.flatnonzero(mine[lo:hi] == j[lo])
            x, y = (v.ravel() for v in np.meshgrid(left, right, indexing="ij"))
        out.append(_reaching(x + lo, y + lo, ids, n, rest, comp, pct))
        size += out[-1].shape[1]
        if size > HELD_PAIRS:
            yield _summed(out)
            out, size = [np.empty((6, 0), np.int64)], 0
    yield _summed(out)


def _summed(parts: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of the same pair added up before they leave the block."""
    a, b, shared, na, nb, rest = np.concatenate([np.empty((6, 0), np.int64), *parts], axis=1)
    order = np.lexsort((b, a))
    a, b, shared, na, nb, rest = (v[order] for v in (a, b, shared, na, nb, rest))
    new = np.flatnonzero(np.r_[np.ones(min(len(a), 1), bool), (np.diff(a) != 0) | (np.diff(b) != 0)])
    if not len(new):
        shared = rest = np.empty(0, np.int64)
    else:
        shared, rest = np.add.reduceat(shared, new), np.minimum.reduceat(rest, new)
    return pa.RecordBatch.from_arrays([
        pa.array(np.zeros(len(new), bool)), pa.array(a[new]), pa.array(b[new]), pa.array(shared), pa.array(na[new]),
        pa.array(nb[new]), pa.array(rest),
    ], names=["long_column", "a", "b", "shared", "na", "nb", "rest"])


def _linked(docs: DataFrame, pairs: DataFrame, width: int, pct: int) -> DataFrame:
    """The pairs ``a, b`` whose whole rows reach the bound.

    First bitmaps of the rows are compared, which take a sixteenth of the bytes and rule out only pairs that cannot reach it.
    """

    @gives_back
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, nx, y, ny in zip(*(batch.column(c).to_pylist() for c in ("x", "nx", "y", "ny"))):
                most = _most_shared(x, nx, y, ny)
                keep.append(most > 0 and 100 * most >= pct * (nx + ny - most))
            yield _kept(batch, keep)

    @gives_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one = np.frombuffer(x.as_buffer(), np.uint64)
                two = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(two, one), max(len(two) - 1, 0))
                both = int((two[at] == one).sum()) if len(two) and len(one) else 0
                keep.append(both > 0 and 100 * both >= pct * (len(one) + len(two) - both))
            yield _kept(batch, keep)

    pairs = materialize(pairs, "pairs")
    for form, scan in ((_bitmap, possible), (np.ndarray.tobytes, compare)):
        joined = _with_rows(docs, pairs, width, form)
        # Rows that repeat an id give a pair several times.
        pairs = materialize(joined.mapInArrow(scan, "a long, b long").distinct(), "pairs")
    return pairs


def _kept(batch: pa.RecordBatch, keep: list[bool]) -> pa.RecordBatch:
    mask = pa.array(keep, pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _with_rows(docs: DataFrame, pairs: DataFrame, width: int, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``a, b, nx, x, ny, y``: pairs with size and ``form`` of both rows."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_of_ids(docs, ids, width, form), "sets")
    # Few pairs go to the rows, so only one side of each pair moves.
    first = sets.select(F.col("id").alias("a"), F.col("n").alias("nx"), F.col("items").alias("x"))
    joined = first.join(broadcast_if_small(pairs, BROADCAST_IDS), "a").join(
        sets.select(F.col("id").alias("b"), F.col("n").alias("ny"), F.col("items").alias("y")), "b"
    )
    return joined.select("a", "b", "nx", "x", "ny", "y")


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, pct: int = SIMILARITY_PCT, long_rows: int = LONG
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of each row of ``docs`` (``doc_id, text``).

    Two documents link when ``100 * intersection >= pct * union`` of their n-gram sets. ``class_id`` is the smallest
    id with the same set, ``component_id`` the smallest id that links reach. Words are runs of anything but blanks,
    A-Z lower-cased. Fewer than ``width`` words are one n-gram together. A null or blank text has no n-gram and
    links with nothing. A null ``doc_id`` is returned with null class and component. Rows that repeat an id
    belong together by that id. N-grams are compared by 64-bit hashes.
    """
    rows = materialize(class_table(docs, width), "classes")
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    by_set = ["n_shingles", "set_a", "set_b"]
    classes = materialize(
        full.groupBy(*by_set).agg(F.min("doc_id").alias("class_id"), F.first("leaders").alias("leaders")), "classes"
    )
    spread = [f"min({c}) <> max({c})" for c in by_set]
    if not full.groupBy("doc_id").agg(F.expr(" OR ".join(spread)).alias("differs")).filter("differs").isEmpty():
        return _with_repeated_ids(docs, width, pct, long_rows)
    groups = classes.select("class_id", "n_shingles", F.posexplode("leaders").alias("turn", "key"))
    leader = groups.groupBy("turn", "key").agg(
        F.min(F.struct(F.col("class_id").alias("a"), F.col("n_shingles").alias("n"))).alias("first"),
        F.count(F.lit(1)).alias("k"),
    ).filter("k > 1").select("turn", "key", "first.a", "first.n")
    fits = 100 * F.least("n", "n_shingles") >= pct * F.greatest("n", "n_shingles")
    stars = (
        groups.join(materialize(leader, "leaders"), ["turn", "key"]).filter((F.col("class_id") != F.col("a")) & fits)
        .select("a", F.col("class_id").alias("b")).distinct()
    )
    near = _linked(docs, stars, width, pct)
    label = connected_components(near)
    known = materialize(
        classes.select(F.col("class_id").alias("id")).join(label, "id", "left")
        .select("id", F.coalesce("component", "id").alias("comp")), "labels"
    )
    # Only one row of each class goes into the product.
    leading = _leading(docs, width, pct, frequent_columns(docs, width)).join(
        broadcast_if_small(known, BROADCAST_IDS), "id"
    )
    found = _linked(docs, _candidates(_postings(leading.select("id", "n", "columns", "comp")), pct, long_rows), width, pct)
    whole = materialize(
        connected_components(near.unionByName(found)).withColumnRenamed("id", "class_id"),
        "components",
    )
    member = rows.join(classes.select(*by_set, "class_id"), by_set, "left").join(whole, "class_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    named = F.col("doc_id").isNotNull()
    return member.select(
        "doc_id", "n_shingles", F.when(named, own).alias("class_id"),
        F.when(named, F.coalesce(F.col("component"), own)).alias("component_id"),
    )


def _with_repeated_ids(docs: DataFrame, width: int, pct: int, long_rows: int) -> DataFrame:
    """The same result where one id stands for different texts: rows are compared under ids of their own."""
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    unique = rows.groupBy("row").agg(F.first("text").alias("text")).withColumnRenamed("row", "doc_id")
    found = jaccard_components(materialize(unique, "rows"), width, pct, long_rows).select(
        F.col("doc_id").alias("row"), "n_shingles", F.col("class_id").alias("set_row"), "component_id"
    )
    member = materialize(rows.select("doc_id", "row").join(found, "row"), "members")
    named = member.filter("doc_id IS NOT NULL")
    first = materialize(named.groupBy("doc_id").agg(F.min("component_id").alias("a")), "first")
    links = named.join(first, "doc_id").select("a", F.col("component_id").alias("b")).distinct()
    joined = connected_components(links).select(F.col("id").alias("component_id"), "component")
    member = member.join(joined, "component_id", "left").withColumn(
        "component", F.coalesce("component", "component_id")
    )
    member = materialize(member, "members")
    named = member.filter("doc_id IS NOT NULL")
    low = named.groupBy("component").agg(F.min("doc_id").alias("low"))
    low_set = named.groupBy("set_row").agg(F.min("doc_id").alias("low_set"))
    out = member.join(materialize(low, "low"), "component", "left").join(materialize(low_set, "low"), "set_row", "left")
    is_named = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_shingles", F.when(is_named, F.col("low_set")).alias("class_id"),
        F.when(is_named, F.col("low")).alias("component_id"),
    )
