"""Phrase collocation mining by suffix automata of shards.

A shard is a bounded stretch of one language's pieces.  Its automaton is laid out as numbers at positions: the number at
a position on depth d names the state that holds the d words which begin there, and 0 stands where pieces end or where
those words are rare.  Two neighbouring numbers of depth d are the two ways from a phrase of d + 1 words: the first is
the state before its last word was read, the second is where its suffix link leads.  So a shard's states of depth d + 1
are its distinct pairs of neighbours, and the sizes of their sets of end positions are counts of those pairs.

Counts are reduced globally depth by depth, so no state below a rare one is opened: words, pairs and triples go to
reducers in packed rows (keys and counts of a shard for one part of the key space), and numbers of those that are frequent over
all come back to the shards that hold them.  Numbers are dense, so pairs of them are exact 64-bit keys, no hashes.
Below frequent triples little is left: there the automaton of the remaining strings is laid out whole, as the tree of
its suffix links, and its states, each with a range of lengths, are summed as rows.  A phrase is subsumed where a suffix
link, or the same step at its other end, leads to it from one more word at the same count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import drop_stage, small_batches, stage

MOST, LEAST_COUNT, FIRST = 5, 100, 2000
#: Words of a shard, at most (a longer document is one shard more); entries of a part, about, and parts at most.
SHARD_WORDS, PART_ENTRIES, MOST_PARTS = 4_000_000, 2_000_000, 100_000
#: First rankings of a language are taken in so many slices.
SLICES = 64
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_SHARDS = "shard long, lang string, words binary, n long, ids binary"


class _Numbers(dict):
    """word -> number from 1, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def pieces_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of each piece: lower-cased A-Z, pieces end at ``.,;:!?`` and at line ends."""
    for piece in (text or b"").lower().translate(_BREAKS).split(b"\n"):
        words = piece.split()  # only spaces and tabs are left
        if words:
            yield words


def packed(g: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte and compressed."""
    planes = np.ascontiguousarray(g.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def squeezed(g: np.ndarray) -> np.ndarray:
    """Runs of 0 are one 0."""
    return g[(g > 0) | np.concatenate([[True], g[:-1] > 0])]


def shards(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """shard, lang, words (one a line, in the order of their numbers), n, ids (numbers, 0 after each piece, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held, made, base = 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            for lang, (numbers, parts) in open_.items():
                if numbers:
                    ids = np.concatenate(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([lang]), pa.array([b"\n".join(numbers)], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([packed(ids)], pa.binary())], [f.split()[0] for f in _SHARDS.split(", ")])
                    made += 1
            open_.clear()
            held = 0

        for batch in small_batches(batches):
            for lang, text, row in zip(*(c.to_pylist() for c in batch.columns)):
                base = row if base is None else base  # rows of a task are numbered in the task's own range
                numbers, parts = open_.setdefault(lang, (_Numbers(), []))
                ids: list[int] = []
                for words in pieces_of(text):
                    ids += map(numbers.__getitem__, words)
                    ids.append(0)
                    if len(ids) >= most:  # a text longer than a shard, between two pieces
                        parts.append(np.array(ids, np.int32))
                        held, ids = held + len(ids), []
                        yield from flush()
                        numbers, parts = open_.setdefault(lang, (_Numbers(), []))
                parts.append(np.array(ids, np.int32))
                held += len(ids)
                if held >= most:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, _SHARDS)


def states(g: np.ndarray, least: int = 1, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of the strings in ``g`` (0 ends a string), cut at ``most`` words: (end, low, high, count) of each state.

    The state's words are the ``low`` to ``high`` words that end at ``end``; its suffix link leads to the state that holds
    the last ``low`` - 1 of them.  States whose longest words are fewer than ``least`` are left out.
    """
    at = np.flatnonzero(g > 0)
    back = np.zeros((most, len(at)), np.int64)  # the words that end at a position, read backwards, 0 from the string's start on
    inside = np.ones(len(at), bool)
    for d in range(most):
        inside = inside & (at >= d)
        back[d, inside] = g[at[inside] - d]
        inside = inside & (back[d] > 0)
    order = np.lexsort(back[::-1])
    at, back = at[order], back[:, order]
    new = np.ones(len(at), bool)
    blocks = []  # of each depth: first position in the order, size
    same = np.zeros(len(at), bool)
    same[1:] = True
    for d in range(most):
        same[1:] &= back[d, 1:] == back[d, :-1]
        new = ~same
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        has = back[d, start] > 0 if len(start) else np.empty(0, bool)
        blocks.append((start[has], size[has]))
    end, low, high, count = [], [], [], []
    opened = np.full(len(at) + 1, 0, np.int64)  # of the block that begins here: its size and the least depth of its state
    depth = np.full(len(at) + 1, 0, np.int64)
    for d, (start, size) in enumerate(blocks, 1):
        goes_on = opened[start] == size  # the block of one word fewer that begins here has the same end positions
        depth[start] = np.where(goes_on, depth[start], d)
        if d < most:
            after, width = blocks[d]
            wide = np.zeros(len(at) + 1, np.int64)
            wide[after] = width
            last = wide[start] != size
        else:
            last = np.ones(len(start), bool)
        last &= d >= least
        end.append(at[start[last]])
        low.append(depth[start[last]])
        high.append(np.full(int(last.sum()), d))
        count.append(size[last])
        opened[:] = 0
        opened[start] = size
    return tuple(np.concatenate(x) for x in (end, low, high, count))


def _by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order that brings parts together, the parts there are, and from where to where each lies in that order."""
    order = np.argsort(part, kind="stable")
    used, start = np.unique(part[order], return_index=True)
    return order, used, list(zip(start.tolist(), [*start[1:].tolist(), len(part)]))


def _words(shard_rows: DataFrame, parts: int) -> DataFrame:
    """part, shard, lang, words, at (the shard's numbers), counts: a shard's words that belong to one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, words, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                words = words.split(b"\n")
                counts = np.bincount(unpacked(ids, n), minlength=len(words) + 1)[1:].astype(np.uint32)
                part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))
                order, used, cut = _by_part(part)
                at = order.tolist()
                cols = [[b"\n".join([words[k] for k in at[i:j]]) for i, j in cut], [(order[i:j] + 1).astype(np.uint32).tobytes() for i, j in cut], [counts[order[i:j]].tobytes() for i, j in cut]]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([shard] * len(used), pa.int64()), pa.array([lang] * len(used)), *[pa.array(c, pa.binary()) for c in cols]], ["part", "shard", "lang", "words", "at", "counts"])

    return shard_rows.mapInArrow(run, "part long, shard long, lang string, words binary, at binary, counts binary")


_REPLIES = "part long, shard long, lang string, keys binary, places binary, counts binary, total long"


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in _REPLIES.split(", ")])


def _frequent_words(words: DataFrame, least: int) -> DataFrame:
    """For each shard its numbers (keys) of frequent words and their places among those of the part.

    Rows without shard hold a language's frequent words of the part (keys, one a line), their places and counts, and
    the count of all its words.
    """

    def reduce(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        total: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        rows = [(shard, lang, own.split(b"\n"), np.frombuffer(at, np.uint32), np.frombuffer(c, np.uint32)) for shard, lang, own, at, c in zip(*(table[x].to_pylist() for x in ("shard", "lang", "words", "at", "counts")))]
        for _, lang, own, _, counts in rows:
            sums = total[lang]
            for w, c in zip(own, counts.tolist()):
                sums[w] += c
        out, place = [], {}
        for lang, sums in total.items():
            held = [(w, c) for w, c in sums.items() if c >= least]
            for w, _ in held:
                place[lang, w] = len(place)
            first = len(place) - len(held)
            out.append((part, None, lang, b"\n".join(w for w, _ in held), np.arange(first, len(place), dtype=np.uint32).tobytes(), np.array([c for _, c in held], np.int64).tobytes(), sum(sums.values())))
        for shard, lang, own, at, _ in rows:
            got = np.array([place.get((lang, w), -1) for w in own], np.int64)
            if (got >= 0).any():
                out.append((part, shard, None, at[got >= 0].tobytes(), got[got >= 0].astype(np.uint32).tobytes(), None, None))
        return _table(out)

    # a word comes once from each shard, so a part holds its share of the words whatever their counts
    return words.groupBy("part").applyInArrow(reduce, _REPLIES)


def _keys(rows: DataFrame, parts: int) -> DataFrame:
    """part, shard, keys, counts: a shard's pairs of neighbouring numbers, the first in the high half, that belong to one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, g in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = np.unique(neighbours(unpacked(g, n))[1], return_counts=True)
                order, used, cut = _by_part(_part_of(keys, parts))
                keys, counts = keys[order], counts[order].astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([shard] * len(used), pa.int64()), pa.array([keys[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([counts[i:j].tobytes() for i, j in cut], pa.binary())], ["part", "shard", "keys", "counts"])

    return rows.select("shard", "n", "g").mapInArrow(run, "part long, shard long, keys binary, counts binary")


def neighbours(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose number and next number are not 0, and the two numbers as one key."""
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))
    return at, (g[at].astype(np.uint64) << np.uint64(32)) | g[at + 1].astype(np.uint64)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def frequent_of(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys whose counts sum up to ``least``, sorted, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(counts, start) if len(keys) else counts
    return keys[start][total >= least], total[total >= least]


def _frequent_keys(rows: DataFrame, least: int) -> DataFrame:
    """As _frequent_words, of keys: for each shard its frequent ones and their places; the totals have no shard."""

    def reduce(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        blobs = [np.frombuffer(b, np.uint64) for b in table["keys"].to_pylist()]
        counts = [np.frombuffer(b, np.uint32) for b in table["counts"].to_pylist()]
        keys, total = frequent_of(np.concatenate(blobs), np.concatenate(counts), least)
        out = [(part, None, None, keys.tobytes(), np.arange(len(keys), dtype=np.uint32).tobytes(), total.tobytes(), None)] if len(keys) else []
        for shard, own in zip(table["shard"].to_pylist(), blobs):
            got = own[np.isin(own, keys)]
            if len(got):
                out.append((part, shard, None, got.tobytes(), np.searchsorted(keys, got).astype(np.uint32).tobytes(), None, None))
        return _table(out)

    return rows.groupBy("part").applyInArrow(reduce, _REPLIES)


def _bases(replies: DataFrame) -> DataFrame:
    """part, base: what a place of the part is added to, to be a number from 1 without gaps.  One count a part goes to the driver."""
    counts = replies.where("shard IS NULL").groupBy("part").agg(F.sum(F.octet_length("places") / 4).cast("long").alias("n")).orderBy("part").collect()
    at, rows = 1, []
    for r in counts:
        rows.append((r.part, at))
        at += r.n
    if at >= 1 << 32:
        raise ValueError("more frequent phrases than 32 bits number")
    return replies.sparkSession.createDataFrame(rows, "part long, base long")


def _told(rows: DataFrame, replies: DataFrame, bases: DataFrame) -> DataFrame:
    """``rows`` with ``told``: the frequent keys of the shard and their numbers, no more than the shard has keys."""
    own = replies.where("shard IS NOT NULL").join(bases, "part").groupBy("shard").agg(F.collect_list(F.struct("keys", "places", "base")).alias("told"))
    return rows.join(own.hint("merge"), "shard")


def _numbers_of(told: list[dict], kind: type) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(t["keys"], kind) for t in told])
    number = np.concatenate([np.frombuffer(t["places"], np.uint32).astype(np.int64) + t["base"] for t in told])
    order = np.argsort(keys)
    return keys[order], number[order]


def _renumbered(rows: DataFrame, words: bool) -> DataFrame:
    """shard, n, g: positions in numbers of the next depth, 0 where the shard was told none; shards without any go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, old, told in zip(*(c.to_pylist() for c in batch.columns)):
                old = unpacked(old, n)
                keys, number = _numbers_of(told, np.uint32 if words else np.uint64)
                at, key = (np.flatnonzero(old), old[old > 0]) if words else neighbours(old)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                g = np.zeros(len(old), np.int64)
                g[at] = np.where(keys[place] == key, number[place], 0)
                g = squeezed(g)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(g)], pa.int64()), pa.array([packed(g)], pa.binary())], ["shard", "n", "g"])

    return rows.mapInArrow(run, "shard long, n long, g binary")


def _named(replies: DataFrame, bases: DataFrame) -> DataFrame:
    """number, lang, word, f of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, places, counts, base in zip(*(c.to_pylist() for c in batch.columns)):
                f = np.frombuffer(counts, np.int64)
                own = words.split(b"\n") if len(f) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(places, np.uint32).astype(np.int64) + base), pa.array([lang] * len(f), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array(f)], ["number", "lang", "word", "f"])

    return replies.where("shard IS NULL").join(bases, "part").select("lang", "keys", "places", "counts", "base").mapInArrow(run, "number long, lang string, word string, f long")


def _linked(replies: DataFrame, bases: DataFrame) -> DataFrame:
    """number, before, link, f of the frequent phrases of a depth: the state before the last word, and the suffix link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, places, counts, base in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(keys, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(places, np.uint32).astype(np.int64) + base), pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["number", "before", "link", "f"])

    return replies.where("shard IS NULL").join(bases, "part").select("keys", "places", "counts", "base").mapInArrow(run, "number long, before long, link long, f long")


def _deepest(rows: DataFrame, most: int) -> DataFrame:
    """s (2 to ``most`` numbers of triples), f: the states of the automaton of the strings that are left, summed over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, g in zip(*(c.to_pylist() for c in batch.columns)):
                g = unpacked(g, n).astype(np.int64)
                end, low, high, count = states(g, 2, most)
                for k in range(0, len(end), 10_000):
                    e, h = end[k : k + 10_000], high[k : k + 10_000]
                    strings = [g[i - m + 1 : i + 1] for i, m in zip(e.tolist(), h.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(h)]).astype(np.int32)), pa.array(np.concatenate(strings))), pa.array(np.maximum(low[k : k + 10_000], 2).astype(np.int32)), pa.array(count[k : k + 10_000].astype(np.int64))], ["s", "low", "c"])

    found = rows.select("shard", "n", "g").mapInArrow(run, "s array<long>, low int, c long")
    every = found.select("s", "c", F.explode(F.sequence(F.col("low"), F.size("s"))).alias("k")).select(F.slice("s", F.size("s") - F.col("k") + 1, F.col("k")).alias("s"), "c")
    return every.groupBy("s").agg(F.sum("c").alias("f"))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, first: int = FIRST, shard_words: int = SHARD_WORDS, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Each language's ``first`` phrases of 2 to MOST words: lang, rank, phrase, a, l, r, n, score.

    ``docs``: text, lang (null: ``und``); a null text is empty; other columns are not read.  n counts the words of
    the language, a the occurrences of the phrase inside pieces.  Cut after k words the score is
    floor(1000 * a * n / (l * r)); the lowest cut counts, ties to the smaller k.  Phrases below ``least`` are no
    candidates, and neither are those inside a longer candidate that occurs as often.  Ranked by score and a, both
    descending, then by the phrase's bytes.  Equal rows count each; an empty table has no rows.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = stage(shards(docs, shard_words), "shards")
    held = every.agg(F.sum("n")).first()[0] or 0
    parts = max(n_parts, min(MOST_PARTS, -(-held // part_entries)))
    replies = stage(_frequent_words(_words(every, parts), least), "words")
    langs = replies.where("shard IS NULL").groupBy("lang").agg(F.sum("total").alias("n"))
    bases = _bases(replies)
    words = stage(_named(replies, bases), "frequent-words")
    rows = stage(_renumbered(_told(every.select("shard", "n", "ids"), replies, bases), True), "depth-1")
    drop_stage(every)
    phrases = [words.select("number", F.array("number").alias("g"), "f")]
    for depth in (2, 3):
        replies = stage(_frequent_keys(_keys(rows, parts), least), f"depth-{depth}-keys")
        bases = _bases(replies)
        deeper = stage(_renumbered(_told(rows, replies, bases), False), f"depth-{depth}")
        drop_stage(rows)
        rows, shorter = deeper, phrases[-1]
        ends = _linked(replies, bases).join(shorter.select(F.col("number").alias("before"), F.col("g").alias("x")), "before").join(shorter.select(F.col("number").alias("link"), F.col("g").alias("y")), "link")
        phrases.append(stage(ends.select("number", F.concat("x", F.slice("y", depth - 1, 1)).alias("g"), "f"), f"depth-{depth}-phrases"))
    deepest = _deepest(rows, MOST - 2).where(F.col("f") >= least).withColumns({"i": F.element_at("s", 1), "j": F.element_at("s", -1)})
    three = phrases[-1]
    ends = deepest.join(three.select(F.col("number").alias("i"), F.col("g").alias("x")), "i").join(three.select(F.col("number").alias("j"), F.col("g").alias("y")), "j")
    long_ = ends.select(F.concat("x", F.slice("y", F.lit(5) - F.size("s"), F.size("s") - 1)).alias("g"), "f")
    grams = long_
    for p in phrases:
        grams = grams.union(p.select("g", "f"))
    grams = stage(grams, "phrases")
    candidates = grams.where(F.size("g") >= 2)
    size = F.size("g")
    # one word more at either end, as often: what contains a phrase more widely contains it so step by step
    inside = candidates.where(size >= 3).select("f", F.explode(F.array(F.slice("g", 1, size - 1), F.slice("g", 2, size - 1))).alias("g")).distinct()
    kept = candidates.join(inside, ["g", "f"], "left_anti")
    cuts = kept.select("g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"x": F.slice("g", 1, F.col("k")), "y": F.slice("g", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(grams.select(F.col("g").alias("x"), F.col("f").alias("l")), "x").join(grams.select(F.col("g").alias("y"), F.col("f").alias("r")), "y")
    named = words.select(F.col("number").alias("w"), "lang", "word")
    spelled = kept.select("g", F.posexplode("g").alias("at", "w")).join(named, "w").groupBy("g").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    spelled = spelled.join(langs, "lang")
    wide = lambda c: f"cast({c} AS decimal(38, 0))"
    scored = cuts.join(spelled, "g").withColumn("score", F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = stage(best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score")), "scored")
    drop_stage(words, rows, replies, grams, *phrases[1:])
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    sliced = best.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).orderBy(*order))).where(F.col("at") <= first)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k >= 2),
i AS (SELECT DISTINCT lang, array_to_string(w[s : s + k - 2], ' ') AS g, f FROM c, (SELECT unnest([1, 2]) AS s) WHERE k >= 3),
q AS (SELECT c.* FROM c ANTI JOIN i ON c.lang = i.lang AND c.g = i.g AND c.f = i.f),
x AS (SELECT lang, g, w, f, k, unnest(range(1, k)) AS u FROM q),
y AS (SELECT x.lang, x.g, x.f AS a, u, l.f AS l, r.f AS r, n, ((1000::HUGEINT * x.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.g = array_to_string(x.w[1 : u], ' ') JOIN f r ON r.lang = x.lang AND r.g = array_to_string(x.w[u + 1 : x.k], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, u) AS b FROM y) WHERE b = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM z) WHERE rank <= {FIRST}
"""
