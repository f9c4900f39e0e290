"""Documents whose sets of word shingles have a Jaccard similarity of at least 3/4, by PartEnum signatures.

Two sets of sizes m <= M with that similarity differ in (m + M) // 7 elements at most. Sets are dealt into bands of sizes
[2**b, 2**(b + 1)); a set also signs for the next band if it can be similar to a set there, so that a similar pair has
the larger one's band in common. The hashed domain of shingles is cut into first-level parts, whose number follows the
band, and each of these into CELLS second-level parts. There are so many first-level parts that in one at least a similar
pair differs in SPOIL second-level parts at most. The signatures of a set are, for each first-level part and each subset
of CELLS - SPOIL of its second-level parts, a hash of all the set's elements in there: a similar pair shares one of them.

Signatures of no element at all would be shared by very many sets. A set leaves them out if it has so many elements
that, however a similar set differs, a signature with elements is shared; a count of the differences that would spoil
each part tells. It also tells in how many parts at least one is shared. A set with fewer such parts has no partner, and
of the others each leaves out what is more frequent than the signatures of all but so many parts.

What follows, all exact:

* texts that are equal are one representative first;
* in every group with one signature, the members are compared with the least one; links are made from pairs whose sets
  pass the test, and components from links. A pair inside one component needs no comparison, so a group of copies costs
  as many comparisons as it has members;
* in groups of SMALL members at most, those of different components are compared with each other;
* the members of larger groups that still hold different components are compared with HUBS other members, and then the
  groups are split: two sets that are similar share one of their rarest shingles that other components have too, when
  of each as many are put aside as the pair needs. A set needs three quarters of its size of such shingles to take part;
* before the sets of a pair meet, short sketches of them must: bits that tell for each bucket of shingles whether there
  is an odd number in it. Each bit that differs is a difference of the sets. From the second comparison on, the members of
  a group bring a shorter sketch with them: of documents that share much and yet too little, which a common passage makes
  of all that hold it, the pairs (as many as the square of the group) are seen in the group only and do not become rows.

Some thousand documents together are the owner of their signatures or shingles. What is asked about a key (how often it
occurs, in how many components) is asked once by each owner, in packed rows, and answered to it if there is another; and
a group's least member is found among each owner's members first. So a key that very many documents have brings a task
one entry for each owner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lean, materialize, slices
from .components import components
from .copies import BROADCAST_IDS, exact_copies, keyed, named, only
from .hashing import mix, shingle_sets, word_hashes

#: Words in a shingle.
SHINGLE = 5
#: Second-level parts of a first-level part, and how many of them may differ.
CELLS, SPOIL = 3, 1
SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Members of a group that are compared with each other without more ado.
SMALL = 32
#: Members that larger groups are compared with before they are split.
HUBS = 8
#: Signatures or shingles of one owner, about; bytes of text for each task that answers, and such tasks at least.
HELD, BLOCK_BYTES, LEAST_BLOCKS = 400_000, 8_000_000, 8
#: Members of a group that one task compares with each other at once.
WIDE = 4_000
#: Bits of a sketch, and of the one that a document brings to each block that has a key of it.
SKETCH, SHORT = 1_024, 512
#: Pairs whose sketches are held side by side.
PAIRS = 100_000


def first_parts(band: np.ndarray) -> np.ndarray:
    """How many first-level parts the domain has for pairs whose larger set is in this band."""
    differ = 2 * ((np.int64(2) << band.astype(np.int64)) - 1) // 7
    # One more than can be spoiled, and some more for parts with too few elements.
    return -(-11 * differ // 20) + 1


def signatures(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(2 * document + parity of band, part, signature), and needs[2 * document + parity]: in how many parts a similar set shares one.

    A set signs for two neighbouring bands at most. Rows are in order of the first two. needs is 0 for a set whose
    shared signature may be one of no element; it has these too.
    """
    sizes = np.diff(ends, prepend=0)
    band = np.where(sizes > 0, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    needs = np.zeros(2 * len(sizes), np.int64)
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    mixed, high = mix(values), values >> np.uint64(32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        takes = np.flatnonzero((sizes > 0) & ((step == 0) | (4 * sizes >= 3 << (band + 1))))
        if not len(takes):
            continue
        own, m = band[takes] + step, sizes[takes]
        n = first_parts(own)
        base, place = CELLS * (np.cumsum(n) - n), np.full(len(sizes), -1)
        place[takes] = np.arange(len(takes))
        at = place[doc_of]
        chosen = at >= 0
        at, x, h = at[chosen], mixed[chosen], high[chosen]
        cell = base[at] + ((h * (CELLS * n[at]).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)  # ascending, as values are
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        sums, filled = np.zeros(CELLS * int(n.sum()), np.uint64), np.zeros(CELLS * int(n.sum()), bool)
        sums[cell[first]], filled[cell[first]] = np.add.reduceat(x, first), True
        sums, filled = sums.reshape(-1, CELLS), filled.reshape(-1, CELLS)
        who = np.repeat(np.arange(len(takes)), n)
        part = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        # A part with elements in one cell is spoiled by one difference, one with elements in more by SPOIL + 1.
        in_cells = filled.sum(axis=1)
        empty, single = np.bincount(who[in_cells == 0], minlength=len(takes)), np.bincount(who[in_cells == 1], minlength=len(takes))
        largest = np.minimum(4 * m // 3, (np.int64(2) << own) - 1)
        differ = (m + largest) // 7
        safe = n - empty - np.minimum(single, differ) - np.minimum(n - empty - single, np.maximum(differ - single, 0) // (SPOIL + 1))
        needs[2 * takes + (own & 1)] = safe
        rows, parts, sigs = [], [], []
        for s, cells in enumerate(SUBSETS):
            keep = filled[:, cells].any(axis=1) | (safe < 1)[who]
            code = (part * len(SUBSETS) + s).astype(np.uint64) * np.uint64(64) + own[who].astype(np.uint64)
            rows.append((2 * takes + (own & 1))[who][keep])
            parts.append(part[keep])
            sigs.append(mix(sums[:, cells].sum(axis=1) + mix(code))[keep])
        out.append(tuple(np.concatenate(c) for c in (rows, parts, sigs)))
    row, part, sig = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.uint64 if i == 2 else np.int64) for i in range(3))
    order = np.lexsort((part, row))
    return row[order], part[order], sig[order], needs


def chosen(row: np.ndarray, part: np.ndarray, sig: np.ndarray, df: np.ndarray, needs: np.ndarray) -> np.ndarray:
    """Which signatures, in order of row and part, a document looks for partners with, if df documents have each.

    Of the signatures that a similar pair shares take the rarest one: in needs - 1 other parts both have one that is no
    rarer. So it is no more frequent than the most frequent signature of each of needs parts, in either document.
    """
    keep = np.flatnonzero(df > 1)
    if not len(keep):
        return keep
    row, part = row[keep], part[keep]
    rank = np.minimum(df[keep], 2**32 - 1).astype(np.uint64) << np.uint64(32) | sig[keep] >> np.uint64(32)
    begins = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    most, owner = np.maximum.reduceat(rank, begins), row[begins]
    order = np.lexsort((~most, owner))
    most, owner = most[order], owner[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    n = np.diff(np.append(first, len(owner)))
    need = np.maximum(needs[owner[first]], 1)
    limit, enough = np.zeros(len(needs), np.uint64), np.zeros(len(needs), bool)
    enough[owner[first]] = n >= need
    limit[owner[first]] = most[first + np.minimum(need, n) - 1]
    return keep[enough[row] & (rank <= limit[row])]


def _blocks(keys: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Rows by key, in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        yield int(keys[b]), {k: v[order[b:e]] for k, v in columns.items()}


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _whole(rest: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    """The same key for the same block and last 32 bits. The blocks grow with the data, so few different keys become one, and none two."""
    return mix(rest.astype(np.uint64) | np.asarray(block).astype(np.uint64) << np.uint64(32))


def _tight(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _loose(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), kind)


#: A packed row is an owner's documents (docs is not null), or what it asks a block about, or what it is told.
_ROW = {"block": pa.int64(), "owner": pa.int64()} | dict.fromkeys(("docs", "m", "c", "needs", "bits", "who", "part", "keys", "n", "low", "high"), pa.binary())
_SCHEMA = ", ".join(f"{k} {'binary' if pa.types.is_binary(t) else 'long'}" for k, t in _ROW.items())
#: Documents of an owner, at most; this place stands for several documents that have a key.
_SEVERAL = 65_535


def _row_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(k) for r in rows], t) for k, t in _ROW.items()], names=list(_ROW))


def _asks(owner: int, x: dict[str, np.ndarray], blocks: int) -> pa.RecordBatch:
    """What an owner asks each block, and its documents, which wait in some block too. x loses its keys."""
    order = np.argsort(x["keys"], kind="stable")
    keys, who, part = (x.pop(k)[order] for k in ("keys", "who", "part"))
    del order
    c = x["c"][who] if len(x["c"]) else None
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(keys)))
    several = n > 1
    group = np.cumsum(several) - 1
    facts = {"keys": keys[first], "several": several, "who": np.where(several, _SEVERAL, who[first]), "part": np.where(several, group, part[first]), "n": n}
    if c is not None and len(first):
        facts |= {"low": np.minimum.reduceat(c, first), "high": np.maximum.reduceat(c, first)}
    rows = []
    for block, y in _blocks(_block_of(facts["keys"], blocks), facts):
        row = {"block": block, "owner": owner, "keys": y["keys"].astype("<u4").tobytes(), "who": _tight(y["who"].astype("<u2")), "part": _tight(y["part"].astype("<u4")), "n": y["n"][y["several"]].astype("<u4").tobytes()}
        rows.append(row | {k: y[k].astype("<i8").tobytes() for k in ("low", "high") if k in y})
    inner = np.repeat(several, n)
    own = {k: x[k].astype("<i8").tobytes() for k in ("docs", "m", "c")} | {"needs": x["needs"].astype("<i4").tobytes(), "bits": x["bits"].tobytes() if "bits" in x else b""}
    own |= {"who": who[inner].astype("<u2").tobytes(), "part": part[inner].astype("<u4").tobytes(), "n": n[several].astype("<u4").tobytes()}
    return _row_batch([*rows, {"block": owner % blocks, "owner": owner} | own])


def _told(table: pa.Table) -> pa.Table:
    """For what a block is asked about: how many documents have it and whether they are of two components, if more than one has."""
    waiting, asked = table.filter(pc.is_valid(table["docs"])), table.filter(pc.is_null(table["docs"]))
    if not asked.num_rows:
        return waiting
    join = lambda k, t: np.frombuffer(b"".join(x or b"" for x in asked[k].to_pylist()), t)
    sizes = [len(x) // 4 for x in asked["keys"].to_pylist()]
    keys = join("keys", "<u4")
    who, part = (np.concatenate([_loose(x, n, t) for x, n in zip(asked[k].to_pylist(), sizes, strict=True)]) for k, t in (("who", "<u2"), ("part", "<u4")))
    count = np.ones(len(keys), np.int64)
    count[who == _SEVERAL] = join("n", "<u4")
    row = np.repeat(np.arange(asked.num_rows), sizes)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    size = np.diff(np.append(first, len(keys)))
    total, foreign = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
    total[order] = np.repeat(np.add.reduceat(count[order], first), size)
    low, high = join("low", "<i8"), join("high", "<i8")
    if len(low):
        foreign[order] = np.repeat(np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first), size)
    keep = np.flatnonzero(total > 1)
    owner, block = asked["owner"].to_pylist(), asked["block"][0].as_py()
    columns = {"keys": keys[keep], "who": who[keep], "part": part[keep], "n": np.minimum(total[keep], 2**32 - 1), "foreign": foreign[keep]}
    rows = [{"block": block, "owner": owner[r], "keys": y["keys"].tobytes(), "who": y["who"].tobytes(), "part": y["part"].tobytes(), "n": y["n"].astype("<u4").tobytes(), "low": y["foreign"].tobytes()} for r, y in _blocks(row[keep], columns)]
    return pa.concat_tables([waiting, pa.Table.from_batches([_row_batch(rows)]).cast(waiting.schema)])


def _answered(docs: DataFrame, read: Callable[[pa.RecordBatch], dict[str, np.ndarray]], blocks: int, use: Callable[[dict[str, np.ndarray]], pa.Table], schema: str, text: str = "text", chars: int = 1_000_000) -> DataFrame:
    """What use makes of an owner's documents and of the keys that others have too.

    read gives of a batch docs, m, c and bits (if they matter), needs (2 a document), and for each key who (the place of
    its document), part and keys. use gets the same with the keys that two documents or more have, in order of who and part,
    with n, how many documents have each, and foreign, whether these are of two components or more.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        owner, held, base, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> pa.RecordBatch:
            return _asks(owner, {k: np.concatenate([h.pop(k) for h in held]) for k in ("docs", "m", "c", "needs", "bits", "who", "part", "keys")}, blocks)

        for batch in (b.slice(i, _SEVERAL // 2) for b in slices(batches, text, chars) for i in range(0, b.num_rows, _SEVERAL // 2)):
            if base + batch.num_rows >= _SEVERAL or n >= HELD:
                yield flush()
                owner, held, base, n = owner + 1, [], 0, 0
            found = read(batch)
            none = np.zeros(0, np.int64)
            found = {"m": none, "c": none, "needs": none, "bits": np.zeros((0, SHORT // 8), np.uint8), "part": np.zeros(len(found["keys"]), np.int64)} | found
            held.append(found | {"who": (found["who"] + base).astype(np.uint16), "part": found["part"].astype(np.uint32)})
            base, n = base + batch.num_rows, n + len(found["keys"])
            del found
        if held:
            yield flush()

    def finish(table: pa.Table) -> pa.Table:
        own, told = table.filter(pc.is_valid(table["docs"])), table.filter(pc.is_null(table["docs"]))
        x = {k: np.frombuffer(own[k][0].as_buffer(), t) for k, t in (("docs", "<i8"), ("m", "<i8"), ("c", "<i8"), ("needs", "<i4"), ("bits", np.uint8))}
        members, parts, sizes = (np.frombuffer(own[k][0].as_buffer(), t) for k, t in (("who", "<u2"), ("part", "<u4"), ("n", "<u4")))
        join = lambda k, t: np.frombuffer(b"".join(told[k].to_pylist()), t)
        keys = _whole(join("keys", "<u4"), np.repeat(np.asarray(told["block"]).astype(np.int64), [len(k) // 4 for k in told["keys"].to_pylist()]))
        who, part, n, foreign = join("who", "<u2"), join("part", "<u4"), join("n", "<u4"), join("low", np.uint8)
        several = who == _SEVERAL
        group = part[several].astype(np.int64)
        begins, size = (np.cumsum(sizes) - sizes)[group].astype(np.int64), sizes[group].astype(np.int64)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)
        both = lambda column, of: np.concatenate((column[~several], of))
        x |= {"who": both(who, members[inner]).astype(np.int64), "part": both(part, parts[inner]).astype(np.int64)}
        x |= {k: both(c, np.repeat(c[several], size)) for k, c in (("keys", keys), ("n", n.astype(np.int64)), ("foreign", foreign.astype(bool)))}
        order = np.lexsort((x["part"], x["who"]))
        return use(x | {k: x[k][order] for k in ("who", "part", "keys", "n", "foreign")})

    return docs.mapInArrow(ask, _SCHEMA).repartition(blocks, "block").groupBy("block").applyInArrow(lean(_told), _SCHEMA).groupBy("owner").applyInArrow(lean(finish), schema)


def _lists(who: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values (in order of who) as one binary for each of n documents, null where there are none."""
    cuts = np.searchsorted(who, np.arange(n + 1))
    return pa.array([values[b:e].astype("<u8").tobytes() if e > b else None for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def _sketched(bits: np.ndarray, who: np.ndarray, n: int) -> pa.Array:
    """The sketches of those of n documents that are in who, as one binary for each, else null."""
    bits, there = bits.reshape(n, SHORT // 8), np.bincount(who, minlength=n) > 0
    return pa.array([x.tobytes() if y else None for x, y in zip(bits, there.tolist(), strict=True)], pa.binary())


def _members(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, m and its signatures that others have too: few, of groups of SMALL at most, and many, of larger ones; bits, its short sketch, if it has any."""

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        values, ends = shingle_sets(*word_hashes(batch["text"]), SHINGLE)
        row, part, sig, needs = signatures(values, ends)
        return {"docs": np.asarray(batch["doc_id"]), "m": np.diff(ends, prepend=0), "needs": needs, "bits": sketches(values, ends, SHORT), "who": row // 2, "part": 2 * part + row % 2, "keys": sig}

    def use(x: dict[str, np.ndarray]) -> pa.Table:
        order = np.lexsort((x["part"] // 2, 2 * x["who"] + x["part"] % 2))
        who, part, sigs, df = (x[k][order] for k in ("who", "part", "keys", "n"))
        keep = chosen(2 * who + part % 2, part // 2, sigs, df, x["needs"].astype(np.int64))
        who, sigs, small = who[keep], sigs[keep], df[keep] <= SMALL
        n = len(x["docs"])
        return pa.table({"doc_id": pa.array(x["docs"]), "m": pa.array(x["m"]), "few": _lists(who[small], sigs[small], n), "many": _lists(who[~small], sigs[~small], n), "bits": _sketched(x["bits"], who, n)})

    return _answered(docs, read, blocks, use, "doc_id long, m long, few binary, many binary, bits binary")


_GROUPS = "block long, docs binary, m binary, c binary, keys binary, others binary, bits binary"


def _runs(keys: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begins, ends) of the runs of equal keys, each in order of then (the last first)."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((*then, keys))
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    return order, first, np.append(first[1:], len(keys))


def _spread(batch: pa.RecordBatch, column: str) -> dict[str, np.ndarray]:
    """docs, m, c, keys and who (the place in the batch): a row for each key in the lists of a column."""
    lists = [np.frombuffer(x, "<u8") for x in batch[column].to_pylist()]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    out = {k: np.repeat(np.asarray(batch[c]).astype("<i8"), n) for k, c in (("docs", "doc_id"), ("m", "m"), ("c", "c"))}
    return out | {"keys": np.concatenate(lists), "who": np.repeat(np.arange(len(n)), n)}


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(7)], names=[x.split()[0] for x in _GROUPS.split(", ")])


def _joined(table: pa.Table, column: str, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table[column].to_pylist()), kind)


def _bits(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Short sketches as rows of whole numbers."""
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), "<u8").reshape(-1, SHORT // 64)


def _brought(x: dict[str, np.ndarray], bits: np.ndarray) -> bytes:
    """The sketches of the documents of some rows, each once, in order of docs. bits: by the place in the batch."""
    return bits[x["who"][np.unique(x["docs"], return_index=True)[1]]].tobytes()


def _places(table: pa.Table, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches, and for each of docs which is its own. Each packed row has brought those of its documents, which no other has."""
    ids = np.concatenate([np.zeros(0, np.int64), *(np.unique(np.frombuffer(x, "<i8")) for x in table["docs"].to_pylist())])
    order = np.argsort(ids)
    return _bits(table["bits"]), order[np.searchsorted(ids[order], docs)] if len(ids) else ids


def _may(bits: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sketches at x and y differ in no more bits than similar sets of m elements together differ in."""
    ok = np.zeros(len(x), bool)
    for i in range(0, len(x), PAIRS):
        k = slice(i, i + PAIRS)
        ok[k] = 7 * np.bitwise_count(bits[x[k]] ^ bits[y[k]]).sum(axis=1, dtype=np.int64) <= m[k]
    return ok


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _once(rows: DataFrame, heaps: int) -> DataFrame:
    """(a, b), each pair once: of packed rows (block, m, others) from all blocks that know it, dealt into heaps by their hash."""

    def unique(table: pa.Table) -> pa.Table:
        return _pairs(_joined(table, "m"), _joined(table, "others"))

    return rows.repartition(heaps, "block").groupBy("block").applyInArrow(lean(unique), "a long, b long")


def _stars(members: DataFrame, column: str, blocks: int, hubs: int = 1, alone: bool = False) -> DataFrame:
    """(a, b), each once: in each group the first member with every other of another component whose size allows a link.

    Two documents share many signatures, which lie in as many blocks; so a block packs its pairs, and only when those of
    all blocks are together a pair becomes a row.

    alone: each document is its own component, and sketches are not asked. The first is the least of each owner's members, and then of these; with hubs, one by a
    hash that differs between so many kinds of signatures.
    """

    def star(x: dict[str, np.ndarray], bits: np.ndarray | None, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the hubs, and of pairs with them. at: where in bits the sketch of each is."""
        by = x["docs"].astype(np.uint64)
        order, begins, ends = _runs(x["keys"], by if hubs == 1 else mix(by + (x["keys"] % np.uint64(hubs)) * np.uint64(0x9E3779B97F4A7C15)))
        hub = np.repeat(order[begins], ends - begins)
        m, c = x["m"], x["c"]
        fits = (order != hub) & (c[order] != c[hub]) & (4 * np.minimum(m[order], m[hub]) >= 3 * np.maximum(m[order], m[hub]))
        hub, other = hub[fits], order[fits]
        if bits is not None:
            fits = _may(bits, at[hub], at[other], m[hub] + m[other])
            hub, other = hub[fits], other[fits]
        return order[begins], hub, other

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 8 * HELD):
            x, bits = _spread(batch, column), None if alone else _bits(batch["bits"])
            first, a, b = star(x, bits, x["who"])
            met = _pairs(x["docs"][a], x["docs"][b])
            a, b = np.asarray(met["a"]).astype("<i8"), np.asarray(met["b"]).astype("<i8")
            rows = [(block, y["docs"].tobytes(), y["m"].astype("<i4").tobytes(), None if alone else y["c"].tobytes(), y["keys"].tobytes(), None, None if alone else _brought(y, bits)) for block, y in _blocks(_block_of(x["keys"][first], blocks), {k: v[first] for k, v in x.items()})]
            rows += [(block, None, y["a"].tobytes(), None, None, y["b"].tobytes(), None) for block, y in _blocks(b % blocks, {"a": a, "b": b})]
            yield _packed(rows)

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table["others"]))
        table = table.filter(pc.is_null(table["others"]))
        x = {k: _joined(table, k, t) for k, t in (("docs", "<i8"), ("m", "<i4"), ("c", "<i8"), ("keys", "<u8"))}
        x["m"] = x["m"].astype(np.int64)
        x["c"] = x["c"] if len(x["c"]) else x["docs"]
        _, a, b = star(x, *((None, None) if alone else _places(table, x["docs"])))
        met = _pairs(np.concatenate((_joined(known, "m"), x["docs"][a])), np.concatenate((_joined(known, "others"), x["docs"][b])))
        a, b = np.asarray(met["a"]), np.asarray(met["b"])
        heap = _block_of(mix(mix(a.astype(np.uint64)) + b.astype(np.uint64)), heaps)
        return pa.Table.from_batches([_packed([(at, None, y["a"].tobytes(), None, None, y["b"].tobytes(), None) for at, y in _blocks(heap, {"a": a, "b": b})])])

    heaps = max(LEAST_BLOCKS, blocks // LEAST_BLOCKS)
    rows = members.where(f"{column} is not null").select("doc_id", "m", "c", column, *["bits"] * (not alone))
    return _once(rows.mapInArrow(local, _GROUPS).repartition(blocks, "block").groupBy("block").applyInArrow(lean(run), _GROUPS), heaps)


def _allowed(m: np.ndarray, c: np.ndarray, use: np.ndarray, own: slice, other: slice) -> np.ndarray:
    """Of two ranges of members (by m), which pairs are of two components and may be similar, by sizes and shared shingles at most."""
    most = 7 * use // 3 - m  # the largest size of a partner
    ok = (c[own, None] != c[None, other]) & (m[None, other] <= most[own, None])
    return ok & (m[own, None] <= most[None, other])


def _within(members: DataFrame, column: str, blocks: int, ranked: bool = False) -> DataFrame:
    """(a, b): in each group all pairs of two components whose sizes and sketches allow a link.

    ranked: m holds use << 32 | size, and the lists are in the order of each document's rarest shingles: what is
    before a group's own shingle does not count, as a pair that shares it is found there.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 8 * HELD):
            x, bits = _spread(batch, column), _bits(batch["bits"])
            if ranked:
                n = np.asarray(pc.binary_length(batch[column])).astype(np.int64) // 8
                x["m"] = x["m"] - ((np.arange(len(x["m"])) - np.repeat(np.cumsum(n) - n, n)) << 32)
            yield _packed([(block, y["docs"].tobytes(), y["m"].tobytes(), y["c"].tobytes(), y["keys"].tobytes(), None, _brought(y, bits)) for block, y in _blocks(_block_of(x["keys"], blocks), x)])

    def pairs(docs: np.ndarray, m: np.ndarray, c: np.ndarray, use: np.ndarray, bits: np.ndarray, cut: int) -> pa.Table:
        """All pairs, or only those of a member before the cut with one after it."""
        n = len(docs)
        own, other = (slice(0, cut), slice(cut, n)) if cut else (slice(0, n), slice(0, n))
        ok = _allowed(m, c, use, own, other)
        i, j = np.nonzero(ok if cut else np.triu(ok, 1))
        j = j + cut
        keep = _may(bits, i, j, m[i] + m[j])
        return _pairs(docs[i[keep]], docs[j[keep]])

    def run(table: pa.Table) -> pa.Table:
        docs, both, c, keys = (_joined(table, k, t) for k, t in (("docs", "<i8"), ("m", "<i8"), ("c", "<i8"), ("keys", "<u8")))
        m, use = (both & 0xFFFFFFFF, both >> 32) if ranked else (both, both)
        bits, place = _places(table, docs)
        order, begins, ends = _runs(keys, docs, m)
        size, most = ends - begins, 7 * use // 3 - m
        a, b, wide = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        # Groups of few members, all at once: each with the next one, then with the one after that, and so on.
        few = np.repeat(size <= 2 * SMALL, size)
        own, group = order[few], np.repeat(np.arange(len(size)), size)[few]
        apart, i = 1, np.arange(len(own))
        while len(i := i[i + apart < len(own)]) and len(i := i[group[i] == group[i + apart]]):
            x, y = own[i], own[i + apart]
            ok = (c[x] != c[y]) & (m[y] <= most[x]) & (m[x] <= most[y])
            x, y = x[ok], y[ok]
            ok = _may(bits, place[x], place[y], m[x] + m[y])
            a.append(docs[x[ok]])
            b.append(docs[y[ok]])
            apart += 1
            if sum(map(len, a)) > 4 * HELD:  # many of them are the same
                met = _pairs(np.concatenate(a), np.concatenate(b))
                a, b = [np.asarray(met["a"])], [np.asarray(met["b"])]
        for at, end in zip(begins[size > 2 * SMALL].tolist(), ends[size > 2 * SMALL].tolist(), strict=True):
            own = order[at:end]
            # A member that not even the smallest one can be similar to takes no part; without it others may not either.
            while len(own) and not (fit := most[own] >= m[own].min()).all():
                own = own[fit]
            if len(own) < 2 or (c[own] == c[own[0]]).all():
                continue
            if len(own) <= WIDE:
                met = pairs(docs[own], m[own], c[own], use[own], bits[place[own]], 0)
                a.append(np.asarray(met["a"]))
                b.append(np.asarray(met["b"]))
                continue
            parts = [own[k : k + WIDE] for k in range(0, len(own), WIDE)]  # by size, so most pairs of parts are too far apart
            for k, p in enumerate(parts):
                wide += [(k * len(parts) + j, *(x[np.concatenate((p, q)) if j > k else p].tobytes() for x in (docs, both, c)), np.array([len(p) if j > k else 0], "<u8").tobytes(), None, bits[place[np.concatenate((p, q)) if j > k else p]].tobytes()) for j, q in enumerate(parts[k:], k) if m[q[0]] <= most[p].max()]
        met = _pairs(np.concatenate(a), np.concatenate(b))
        n = met.num_rows
        rest = pa.Table.from_batches([_packed(wide)])
        return pa.table({"a": pa.concat_arrays([met["a"].combine_chunks(), pa.nulls(len(wide), pa.int64())]), "b": pa.concat_arrays([met["b"].combine_chunks(), pa.nulls(len(wide), pa.int64())])} | {k: pa.concat_arrays([pa.nulls(n, rest[k].type), rest[k].combine_chunks()]) for k in rest.column_names})

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table = batch.slice(i, 1)
                both = _joined(table, "m")
                m, use = (both & 0xFFFFFFFF, both >> 32) if ranked else (both, both)
                yield from pairs(_joined(table, "docs"), m, _joined(table, "c"), use, _bits(table["bits"]), int(_joined(table, "keys")[0])).to_batches()

    rows = members.where(f"{column} is not null").select("doc_id", "m", "c", column, "bits")
    met = materialize(rows.mapInArrow(deal, _GROUPS).repartition(blocks, "block").groupBy("block").applyInArrow(lean(run), "a long, b long, " + _GROUPS), "met")
    pairs_met, split = met.where("a is not null").select("a", "b"), met.where("a is null").drop("a", "b")
    if not split.isEmpty():
        pairs_met = pairs_met.unionByName(split.repartition(blocks).mapInArrow(wide, "a long, b long"))
    return pairs_met.distinct()


def _mixed(members: DataFrame, blocks: int) -> DataFrame:
    """doc_id and c of the members of large groups that have more than one component c."""

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        n = np.asarray(pc.binary_length(batch["many"])).astype(np.int64) // 8
        return {"docs": np.asarray(batch["doc_id"]), "c": np.asarray(batch["c"]), "who": np.repeat(np.arange(batch.num_rows), n), "keys": _spread(batch, "many")["keys"]}

    def use(x: dict[str, np.ndarray]) -> pa.Table:
        own = np.unique(x["who"][x["foreign"]])
        return pa.table({"doc_id": pa.array(x["docs"][own]), "c": pa.array(x["c"][own])})

    rows = members.where("many is not null").select("doc_id", "m", "c", "many")
    return _answered(rows, read, blocks, use, "doc_id long, c long", "many", 8 * HELD)


def _usable(docs: DataFrame, parts: DataFrame, blocks: int) -> DataFrame:
    """doc_id, c and m of the documents in parts (doc_id, c), and use, their rarest shingles, of those that another component has too.

    m is the number of these << 32 | the size. Documents with less than three quarters of their size of them are left
    out; of the others as many are in use as a similar set has one of at least. bits is the short sketch.
    """

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        values, ends = shingle_sets(*word_hashes(batch["text"]), SHINGLE)
        n = np.diff(ends, prepend=0)
        return {"docs": np.asarray(batch["doc_id"]), "m": n, "c": np.asarray(batch["c"]), "bits": sketches(values, ends, SHORT), "who": np.repeat(np.arange(batch.num_rows), n), "keys": values}

    def use(x: dict[str, np.ndarray]) -> pa.Table:
        n, m = len(x["docs"]), x["m"]
        who, keys, df = (x[k][x["foreign"]] for k in ("who", "keys", "n"))
        order = np.lexsort((keys, df, who))
        who, keys = who[order], keys[order]
        count = np.bincount(who, minlength=n)
        place = np.arange(len(who)) - (np.cumsum(count) - count)[who]
        keep = (4 * count >= 3 * m)[who] & (place < (count - -(-3 * m // 4) + 1)[who])
        return pa.table({"doc_id": pa.array(x["docs"]), "m": pa.array(count << 32 | m), "c": pa.array(x["c"]), "use": _lists(who[keep], keys[keep], n), "bits": _sketched(x["bits"], who[keep], n)})

    few = parts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(parts) if few else parts, "doc_id").select("doc_id", "c", "text")
    return _answered(rows, read, blocks, use, "doc_id long, m long, c long, use binary, bits binary").where("use is not null")


def sketches(values: np.ndarray, ends: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """For each set, so many bits as bytes: whether a bucket has an odd number of elements."""
    who = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    key, n = np.unique(who * size + (mix(values) % np.uint64(size)).astype(np.int64), return_counts=True)
    key = key[n % 2 == 1]
    return np.bincount(key >> 3, weights=(1 << (key & 7)).astype(float), minlength=len(ends) * size // 8).astype(np.uint8).reshape(len(ends), -1)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose sets are similar. Only sets of documents of a pair whose sketches meet are moved."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=1_000_000):
            values, ends = shingle_sets(*word_hashes(batch["text"]), SHINGLE)
            lists = pa.array([x.astype("<u8").tobytes() for x in np.split(values, ends[:-1])], pa.binary())
            bits = pa.array([x.tobytes() for x in sketches(values, ends)], pa.binary())
            yield pa.record_batch([batch["doc_id"], pa.array(np.diff(ends, prepend=0), pa.int64()), bits, lists], names=["doc_id", "m", "bits", "values"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("x", "y"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = 7 * apart <= np.asarray(batch["m"]) + np.asarray(batch["o"])
            yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= 75 * (len(x) + len(y) - same))
            yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        """pairs with a column of a, which may be the hub of very many, as x (and its m), and of b as y (and its m as o)."""
        hubs = only(held, pairs.groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("n")), "inner").select(F.col("doc_id").alias("a"), "n", "m", F.col(column).alias("x"))
        rows = join_counted(pairs, materialize(hubs, "hubs"), ["a"])
        return rows.join(held.select(F.col("doc_id").alias("b"), F.col("m").alias("o"), F.col(column).alias("y")), "b").select("a", "b", "m", "o", "x", "y")

    def ids(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")

    held = materialize(only(docs, ids(pairs)).mapInArrow(sets, "doc_id long, m long, bits binary, values binary"), "sets")
    pairs = materialize(with_both(pairs, "bits").mapInArrow(near, "a long, b long"), "near")
    held = only(held, ids(pairs))
    return with_both(pairs, "values").mapInArrow(test, "a long, b long")


def _components(docs: DataFrame, reps: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, m) of different texts, and (node, component) of those with links."""
    members = materialize(_members(reps, blocks), "members")
    sizes, members = members.select("doc_id", "m"), members.where("few is not null or many is not null")

    def placed(parts: DataFrame | None) -> DataFrame:
        if parts is None:
            return members.withColumn("c", F.col("doc_id"))
        own = parts.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "c")
        return materialize(members.join(own, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "placed")

    tested = parts = None

    def linked(pairs: DataFrame) -> None:
        nonlocal tested, parts
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialize(_verified(docs, pairs), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if parts is None:
            parts = components(found)
        elif not found.isEmpty():  # what is connected already is a star, which is settled at once
            parts = components(found.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    now = placed(None)
    linked(_stars(now, "few", blocks, alone=True).unionByName(_stars(now, "many", blocks, alone=True)).distinct())
    now = placed(parts)
    linked(_within(now, "few", blocks).unionByName(_stars(now, "many", blocks, HUBS)).distinct())
    mixed = materialize(_mixed(placed(parts), blocks), "mixed")
    if not mixed.isEmpty():
        linked(_within(materialize(_usable(docs, mixed, blocks), "usable"), "use", blocks, ranked=True))
    return sizes, parts


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of documents (doc_id, text) with ids of their own."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    copies, total = exact_copies(docs)
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    sizes, parts = _components(docs, only(docs, copies.select("doc_id"), "left_anti"), blocks)
    reached = sizes.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("m").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    reached = materialize(reached, "reached")
    of_copies = materialize(copies.groupBy("rep").agg(F.count("*").alias("n")).join(reached.withColumnRenamed("doc_id", "rep"), "rep"), "classes")
    again = join_counted(copies, of_copies, ["rep"]).select("doc_id", "n_shingles", "component_id")
    return reached.unionByName(again).withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    Links are pairs of sets with 100 * intersection >= 75 * union. A null or empty text, or one without words, has no
    shingles and no links. Every row is a document of its own, also rows that share a doc_id or have none; a component
    of documents without ids has none. Other columns are ignored; an empty table gives no rows.
    """
    docs, names = keyed(docs, key, text)
    return named(_classes(docs), names, "doc_id", "component_id")


def filter_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the least doc_id, all its columns unchanged."""
    docs, _ = keyed(docs, whole=True)
    copies = materialize(_classes(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id"), "copies")
    return only(docs, copies, "left_anti").select("row.*")
