"""Line dedup: an exact set-similarity join of lines that removes later matches.

A line is the set of its distinct ASCII-lower-cased words. A line is removed if an earlier one
(by document id, then line number) has a Jaccard index of at least PERCENT / 100 with it,
whether that one is itself removed or not. Lines of any length take part; among lines of up
to 3 words this is equality.

Tokens are ordered by rarity (in how many lines they are, from a table of fixed size, then by
hash). Two matching lines of n words share one of their first n - ceil(t n) + 1; those are
indexed, without tokens that one line alone has. Within a token, lines of equal size and sketch
stand for one another, and between the others the length filter, the positional filter and a
128-bit parity sketch of the sets (its bits that differ are never more than the words that
differ) leave candidates, which are verified on the lines themselves.

A line needs one earlier match, not all. So for each line and token the KEPT candidates with the
fewest differing bits are listed. The best of a line is verified first, then, where it fails, all
that are listed; only lines that fail there and had more candidates than the list holds are joined
with all of them. Very frequent tokens are indexed by token and length class, so that their groups
are split. Equal sets met in one task are decided there.

Defined cases: null or empty texts and lines without words stay as they are; texts and lines of
any length are taken whole; of equal lines the first stays, by id, then line number; null ids
order first; rows that repeat an id are one document, whose lines are told apart by number and
sketch (equal rows lose the same lines); an empty table gives an empty result; other columns are
kept, whatever their names, but n_lines, n_removed and removed_share are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import GOLDEN, Scratch, Words, as_bytes, bitmap, byte_table, chunks, extended, free_name, in_bitmap, map_batches, mixed, read, staged, with_columns

PERCENT = 80
#: Candidates listed for each line and token; the rest of them has an exact way of its own.
KEPT = 4
TABLE_BITS, FILTER_BITS, SEEN, FLUSH = 24, 25, 200_000, 4_000_000
#: Tokens of this class (4 log2 of their lines: 200,000 lines) are split by length class.
SPLIT_CLASS = 70
NO_ID = -(1 << 63)
#: Ids broadcast at most (8 bytes each) to pick documents; beyond, all are looked at.
FEW_DOCS = 100_000


class Lines:
    """The distinct words of the lines of some texts as arrays, line after line, in the order of tokens.

    A token is a word's class (TABLE_BITS of its hash say which) and 39 more bits of its hash; words that fall
    together only add candidates. token, line (index); text, number and size of each line."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        words = Words(column)
        numbers = words.lines()
        new = np.ones(len(words.h), bool)
        new[1:] = (words.owner[1:] != words.owner[:-1]) | (numbers[1:] != numbers[:-1])
        index = np.cumsum(new) - 1
        classes = table[(words.h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64) if table is not None else np.uint64(0)
        token = (classes << np.uint64(39)) | (words.h & np.uint64((1 << 39) - 1))
        parts = []
        for low in range(0, int(index[-1]) + 1 if len(index) else 0, 1 << 18):  # an index needs 18 bits
            own = slice(*np.searchsorted(index, [low, low + (1 << 18)]))
            key = np.sort(((index[own] - low).astype(np.uint64) << np.uint64(46)) | token[own])
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            parts.append((key & np.uint64((1 << 46) - 1), (key >> np.uint64(46)).astype(np.int64) + low))
        token, line = (np.concatenate([p[i] for p in parts]) for i in (0, 1)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        first = np.flatnonzero(new)
        self.token, self.line = token, line
        self.texts, self.numbers, self.sizes = words.owner[first], numbers[first], np.bincount(line, minlength=len(first))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """Two words of the parity sketch of each line: a word flips one of 128 bits."""
        bit = np.uint64(1) << (self.token & np.uint64(63))
        high = (self.token & np.uint64(64)) != 0
        return tuple(np.bitwise_xor.reduceat(np.where(high == side, bit, np.uint64(0)), self.starts).view(np.int64) for side in (False, True))

    def keys(self, sketches: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """192 bits of each line's set: the sketches and a sum of hashes."""
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed(self.token & np.uint64((1 << 39) - 1)), self.starts)
        return np.stack([total.view(np.int64), *sketches], axis=1).view("V24").ravel().tolist()


def slots_of(token: np.ndarray) -> np.ndarray:
    """The filter slot of a token."""
    return (mixed(token) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def tell_of(sketch: np.ndarray, sketch2: np.ndarray) -> np.ndarray:
    """A long that tells the lines of one document and number apart."""
    with np.errstate(over="ignore"):
        return mixed(mixed(sketch.view(np.uint64)) * GOLDEN + sketch2.view(np.uint64)).view(np.int64)


def tells(lines: list[bytes]) -> np.ndarray:
    """The tell of each line; 0 for lines without words."""
    found = Lines(pa.array([x.replace(b"\n", b" ") for x in lines], pa.binary()))
    out = np.zeros(len(lines), np.int64)
    if len(found.sizes):
        out[found.texts] = tell_of(*found.sketches())
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """A byte per slot of word hashes: 0 where one word of the documents at most is, else 4 log2 of their number."""

    def work(batches):
        held, n = [], 0

        def out():
            values, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(count.astype(np.int64))], names=["slot", "times"])

        for batch in chunks(batches, "text"):
            held.append((Words(batch.column("text")).h >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
            n += len(held[-1])
            if n > FLUSH:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    counted = map_batches(docs, work, "slot int, times bigint").groupBy("slot").agg(F.sum("times").alias("times")).where("times > 1")
    return byte_table(counted.select("slot", F.floor(F.least(F.lit(127), 4 * F.log2("times"))).alias("value")), TABLE_BITS)


#: An index row without its token; rows travel packed, as one binary column, to the comparison of groups.
ROW = np.dtype([("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), ("place", "<i4"), ("sketch", "<i8"), ("sketch2", "<i8"), ("guest", "u1")])
#: Index rows compared at once (more where a group is larger).
GROUP_ROWS = 200_000


def packed(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * ROW.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, ROW, len(column), first) if len(column) else np.empty(0, ROW)


INDEX = "token bigint, doc bigint, line int, size int, place int, sketch bigint, sketch2 bigint, guest boolean, tell bigint"
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def indexed(docs: DataFrame, table, only=None) -> DataFrame:
    """Prefix rows, packed; rows without a token tell lines equal to an earlier one of the same task.

    only: bits of wanted tokens; then the rows have columns of their own, and equal lines are left out."""

    def prefixes(lines: Lines, use: np.ndarray):
        """Of the lines marked in use: (line, token, place, whether the token is split)."""
        place = np.arange(len(lines.token)) - np.repeat(lines.starts, lines.sizes)
        n = lines.sizes[lines.line]
        c = lines.token >> np.uint64(39)
        keep = (place < n + (-PERCENT * n // 100) + 1) & (c > 0) & use[lines.line]
        return lines.line[keep], lines.token[keep], place[keep], c[keep] >= SPLIT_CLASS

    def work(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in chunks(batches, "text"):
            lines = Lines(batch.column("text"), table.value)
            if not len(lines.sizes):
                continue
            docs_of = np.asarray(batch.column("id"))[lines.texts]
            sketches, seconds = lines.sketches()
            use, later = np.ones(len(lines.sizes), bool), []
            for i, (key, at) in enumerate(zip(lines.keys((sketches, seconds)), zip(docs_of.tolist(), lines.numbers.tolist(), strict=True), strict=True)):
                known = seen.get(key)
                if known is None or at < known:
                    seen[key] = at
                    if known:
                        later.append((*known, int(sketches[i]), int(seconds[i])))
                elif at != known:
                    use[i] = False
                    later.append((*at, int(sketches[i]), int(seconds[i])))
            if len(seen) > SEEN:
                seen.clear()
            if later and only is None:
                rows = np.zeros(len(later), ROW)
                rows["doc"], rows["line"], rows["sketch"], rows["sketch2"] = zip(*later, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(later), pa.int64()), packed(rows)], names=["token", "row"])
            own, token, place, split = prefixes(lines, use)
            guest = np.zeros(len(own), bool)
            if split.any():
                level = np.floor(np.log(lines.sizes[own]) / math.log(100 / PERCENT) + 1e-9).astype(np.uint64)
                again = np.flatnonzero(split)
                with np.errstate(over="ignore"):
                    own_key = np.where(split, mixed(token + (level + np.uint64(1)) * GOLDEN), token)
                    guest_key = mixed(token[again] + (level[again] + np.uint64(2)) * GOLDEN)
                token = np.concatenate([own_key, guest_key])
                own, place, guest = np.concatenate([own, own[again]]), np.concatenate([place, place[again]]), np.concatenate([guest, np.ones(len(again), bool)])
            if only is not None:
                keep = in_bitmap(only.value, slots_of(token))
                own, token, place, guest = own[keep], token[keep], place[keep], guest[keep]
            rows = np.zeros(len(own), ROW)
            for name, x in zip(ROW.names, (docs_of[own], lines.numbers[own], lines.sizes[own], place, sketches[own], seconds[own], guest), strict=True):
                rows[name] = x
            key = pa.array(token.view(np.int64))
            if only is None:
                yield pa.RecordBatch.from_arrays([key, packed(rows)], names=["token", "row"])
            else:
                yield pa.RecordBatch.from_arrays([key, *(pa.array(rows[n]) for n in ROW.names[:-1]), pa.array(rows["guest"] != 0), pa.array(tell_of(rows["sketch"].copy(), rows["sketch2"].copy()))], names=INDEX_NAMES)

    return map_batches(docs, work, "token bigint, row binary" if only is None else INDEX)


def apart_of(s, t, s2, t2) -> np.ndarray:
    return np.bitwise_count(s ^ t).astype(np.int64) + np.bitwise_count(s2 ^ t2)


def passing(n, m, i, j, s, t, s2, t2) -> np.ndarray:
    """Positional and sketch filters for arrays of pairs that the length filter has passed."""
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    ok = 1 + np.minimum(i, j) + np.minimum(n - i - 1, m - j - 1) >= need
    at = np.flatnonzero(ok)
    ok[at] = apart_of(s[at], t[at], s2[at], t2[at]) <= (n + m - 2 * need)[at]
    return ok


CANDIDATES = "decided boolean, doc bigint, line int, tell bigint, to_doc bigint, to_line int, to_tell bigint, apart int, more boolean, token bigint"
CANDIDATE_NAMES = [x.split()[0] for x in CANDIDATES.split(", ")]
#: Pairs held at once while a group is compared; beyond, all but the nearest KEPT of each row are let go.
HELD_PAIRS = 2_000_000


def nearest(pairs: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Of (row, other, bits apart), the KEPT nearest of each row."""
    x, y, gap = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
    order = np.lexsort((gap, x))
    x, y, gap = x[order], y[order], gap[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x) < KEPT
    return [(x[keep], y[keep], gap[keep])]


def candidates(rows: DataFrame) -> DataFrame:
    """For each line and token, the earlier lines with the least differing bits, and whether there are more.

    Rows come sorted by token. Of rows of a group with equal sizes and sketches the earliest is the others' candidate
    and alone is compared further. Those are put in order of size, and rows of all groups are compared with
    those 1, 2, ... places before them, as long as the length filter lets a row's distance grow."""

    def groups(batches):
        """(tokens, rows) of whole groups, GROUP_ROWS rows or one group at least."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            without = batch.filter(pc.is_null(batch.column("token")))
            if without.num_rows:
                yield None, unpacked(without.column("row"))
                batch = batch.filter(pc.is_valid(batch.column("token")))
            if not batch.num_rows:
                continue
            token, rows = np.asarray(batch.column("token")), unpacked(batch.column("row"))
            cut = int(np.searchsorted(token, token[-1]))  # where the last group starts
            if n + cut >= GROUP_ROWS and (cut or held[-1][0][-1] != token[0]):
                yield tuple(np.concatenate(x) for x in zip(*held, (token[:cut], rows[:cut]), strict=True))
                held, n = [(token[cut:], rows[cut:])], len(token) - cut
            else:
                held.append((token, rows))
                n += len(token)
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def standing_for(token, rows):
        """The row that stands for each: the earliest of equal size and sketch in the group."""
        with np.errstate(over="ignore"):
            same = mixed(token.view(np.uint64) * GOLDEN + tell_of(rows["sketch"].copy(), rows["sketch2"].copy()).view(np.uint64) + rows["size"].astype(np.uint64))
        order = np.argsort(same)
        run = np.cumsum(np.concatenate(([0], same[order][1:] != same[order][:-1])))
        several = np.flatnonzero(np.bincount(run)[run] > 1)
        out = np.arange(len(token))
        if len(several):
            at, run = order[several], run[several]
            by = np.lexsort((rows["line"][at], rows["doc"][at], run))
            at, run = at[by], run[by]
            first = np.searchsorted(run, run)
            out[at] = at[first]
        return out

    def work(batches):
        for token, rows in groups(batches):
            tell = tell_of(rows["sketch"].copy(), rows["sketch2"].copy())
            if token is None:  # lines already decided
                none = lambda t: pa.nulls(len(rows), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), bool)), pa.array(rows["doc"].copy()), pa.array(rows["line"].copy()), pa.array(tell), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.bool_()), none(pa.int64())], names=CANDIDATE_NAMES)
                continue
            stands = standing_for(token, rows)
            own = np.arange(len(token))
            copies = np.flatnonzero((stands != own) & (rows["guest"] == 0) & ((rows["doc"] != rows["doc"][stands]) | (rows["line"] != rows["line"][stands])))
            alone = np.flatnonzero(stands == own)
            alone = alone[np.lexsort((rows["size"][alone], token[alone]))]
            key, part = token[alone], rows[alone]
            doc, line, guest = part["doc"].copy(), part["line"].copy(), part["guest"] != 0
            n, i, s, s2 = part["size"].astype(np.int64), part["place"].astype(np.int64), part["sketch"].copy().view(np.uint64), part["sketch2"].copy().view(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            counts, pairs, held = np.zeros(len(key), np.int64), [], 0
            active, lag = np.arange(len(key)), 0
            while True:
                lag += 1
                active = active[place[active] >= lag]
                active = active[100 * n[active - lag] >= PERCENT * n[active]]
                if not len(active):
                    break
                back = active - lag
                ok = passing(n[active], n[back], i[active], i[back], s[active], s[back], s2[active], s2[back])
                at, to = active[ok], back[ok]
                ok = ~(guest[at] & guest[to]) & ((doc[at] != doc[to]) | (line[at] != line[to]))
                at, to = at[ok], to[ok]
                if not len(at):
                    continue
                gap = apart_of(s[at], s[to], s2[at], s2[to])
                later = (doc[at] > doc[to]) | ((doc[at] == doc[to]) & (line[at] > line[to]))
                x, y = np.where(later, at, to), np.where(later, to, at)
                counts += np.bincount(x, minlength=len(counts))
                pairs.append((x, y, gap))
                held += len(x)
                if held > HELD_PAIRS:
                    pairs = nearest(pairs)
                    held = len(pairs[0][0])
            x, y, gap = nearest(pairs)[0]
            more = counts[x] > KEPT
            x, y = np.concatenate([alone[x], copies]), np.concatenate([alone[y], stands[copies]])
            gap, more = np.concatenate([gap, np.zeros(len(copies), np.int64)]), np.concatenate([more, np.ones(len(copies), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), bool)), pa.array(rows["doc"][x]), pa.array(rows["line"][x]), pa.array(tell[x]), pa.array(rows["doc"][y]), pa.array(rows["line"][y]), pa.array(tell[y]), pa.array(gap.astype(np.int32)), pa.array(more), pa.array(token[x])], names=CANDIDATE_NAMES)

    return map_batches(rows, work, CANDIDATES)


def line_slots(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(doc.view(np.uint64) * GOLDEN + line.astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


LINE, OTHER = ["doc", "line", "tell"], ["to_doc", "to_line", "to_tell"]


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, few: bool = True) -> DataFrame:
    """(doc, line, tell) of the pairs (doc, line, tell, to_doc, to_line, to_tell) whose lines match.

    few: where no more than FEW_DOCS documents are in the pairs, the others' texts are not read by Python."""

    def slots(batches):
        for b in batches:
            both = [line_slots(np.asarray(b.column(d)), np.asarray(b.column(n))) for d, n in (("doc", "line"), ("to_doc", "to_line"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(both)).astype(np.int32))], names=["slot"])

    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(map_batches(pairs.select("doc", "line", "to_doc", "to_line"), slots, "slot int"), FILTER_BITS))

    def some(batches):
        for batch in chunks(batches, "text"):
            ids, texts = np.asarray(batch.column("id")), as_bytes(batch.column("text"))
            counts = np.array([t.count(b"\n") + 1 if t else 1 for t in texts])
            owner = np.repeat(np.arange(len(texts)), counts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.flatnonzero(in_bitmap(wanted.value, line_slots(ids[owner], number)))
            found, last, parts = [], -1, []
            for o, n in zip(owner[hit].tolist(), number[hit].tolist(), strict=True):
                if o != last:
                    last, parts = o, (texts[o] or b"").split(b"\n")
                found.append(parts[n])
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[hit]]), pa.array(number[hit].astype(np.int32)), pa.array(tells(found)), pa.array(found, pa.binary())], names=[*LINE, "words"])

    ids = pairs.select("doc").unionByName(pairs.select(F.col("to_doc").alias("doc"))).distinct().limit(FEW_DOCS + 1)
    if few and (ids := scratch.staged(ids, "line-docs")).count() <= FEW_DOCS:
        docs = docs.join(F.broadcast(ids), F.col("id") == F.col("doc"), "left_semi")
    lines = scratch.staged(map_batches(docs, some, "doc bigint, line int, tell bigint, words binary"), "line-texts")
    both = pairs.join(lines, LINE).join(lines.select(*[F.col(c).alias(f"to_{c}") for c in [*LINE, "words"]]), OTHER)

    def check(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("words").to_pylist(), batch.column("to_words").to_pylist(), strict=True):
                a, b = set(a.lower().split()), set(b.lower().split())
                keep.append(100 * len(a & b) >= PERCENT * len(a | b))
            yield batch.select(LINE).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select(*LINE, "words", "to_words"), check, "doc bigint, line int, tell bigint").distinct()


def later_matches(docs: DataFrame) -> DataFrame:
    """(doc, line, tell) of the lines that match an earlier one, staged; docs has id and text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = spark.sparkContext.broadcast(rarity(docs))
    # rows without a token are dealt by their document: one null key would gather them in a task
    rows = indexed(docs, table)
    rows = rows.repartition(F.coalesce("token", F.xxhash64("row"))).sortWithinPartitions("token")
    found = scratch.staged(candidates(rows), "line-candidates")
    equal = found.where("decided").select(*LINE)
    near = found.where("not decided")
    to = F.struct(*OTHER)
    best = near.groupBy(*LINE).agg(F.min(F.struct("apart", *OTHER)).alias("b"), (F.max(to) != F.min(to)).alias("several"), F.max("more").alias("more"))
    best = scratch.staged(best.select(*LINE, *[F.col(f"b.{c}") for c in OTHER], "several", "more"), "line-pairs")
    sure = scratch.staged(verified(docs, best, scratch, False), "line-matches")
    removed = equal.unionByName(sure)
    left = scratch.staged(best.where("several or more").join(sure, LINE, "left_anti"), "line-left")
    if not left.isEmpty():
        # all that are listed, of these lines
        listed = near.join(left.select(*LINE), LINE, "left_semi").select(*LINE, *OTHER).distinct()
        listed = scratch.staged(listed.join(left.select(*LINE, *OTHER), [*LINE, *OTHER], "left_anti"), "line-pairs")
        second = scratch.staged(verified(docs, listed, scratch), "line-matches")
        removed = removed.unionByName(second)
        rest = scratch.staged(left.where("more").select(*LINE).join(second, LINE, "left_anti"), "line-rest")
        if not rest.isEmpty():
            tested = left.select(*LINE, *OTHER).unionByName(listed)
            removed = removed.unionByName(verified(docs, remaining(docs, table, near, rest, tested, scratch), scratch))
    out = staged(removed.distinct(), "line-removed")
    scratch.drop()
    return out


def remaining(docs: DataFrame, table, near: DataFrame, rest: DataFrame, tested: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs of the lines in rest that pass the filters and were not tested."""

    def slots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots_of(np.asarray(b.column(0)).view(np.uint64)))], names=["slot"])

    tokens = near.where("more").join(rest, LINE, "left_semi").select("token")
    only = docs.sparkSession.sparkContext.broadcast(bitmap(map_batches(tokens, slots, "slot bigint"), FILTER_BITS))
    part = scratch.staged(indexed(docs, table, only).where("token is not null"), "line-index")
    x = part.join(rest, LINE, "left_semi")
    y = part.select("token", *[F.col(c).alias(f"to_{c}") for c in INDEX_NAMES[1:]])
    need = F.ceil(PERCENT * (F.col("size") + F.col("to_size")) / (100 + PERCENT))
    earlier = F.struct("to_doc", "to_line") < F.struct("doc", "line")
    fits = (100 * F.least("size", "to_size") >= PERCENT * F.greatest("size", "to_size")) & (1 + F.least("place", "to_place") + F.least(F.col("size") - F.col("place") - 1, F.col("to_size") - F.col("to_place") - 1) >= need)
    close = F.bit_count(F.col("sketch").bitwiseXOR(F.col("to_sketch"))) + F.bit_count(F.col("sketch2").bitwiseXOR(F.col("to_sketch2"))) <= F.col("size") + F.col("to_size") - 2 * need
    pairs = x.join(y, "token").where(earlier & ~(F.col("guest") & F.col("to_guest")) & fits & close).select(*LINE, *OTHER).distinct()
    return scratch.staged(pairs.join(tested, [*LINE, *OTHER], "left_anti"), "line-pairs")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without its removed lines, and n_lines, n_removed (lines) and removed_share (of its words)."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    removed = later_matches(docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(removed.select(slot("doc")), FILTER_BITS))
    key_name, slot_name, list_name = (free_name(docs, n) for n in ("__key", "__slot", "__removed"))
    kept = docs.withColumns({key_name: key, slot_name: slot(key)})

    def part(hit: bool):
        """Documents that may have removed lines, which are joined with them, and the others, which are not moved."""

        def pick(batches):
            for batch in batches:
                at = np.asarray(batch.column(slot_name)).astype(np.int64)
                yield batch.filter(pa.array(in_bitmap(wanted.value, at) == hit))

        return map_batches(kept, pick, kept.schema)

    lists = removed.groupBy(F.col("doc").alias(key_name)).agg(F.collect_list(F.struct("line", "tell")).alias(list_name))
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = part(True).join(lists, key_name, "left").select(*own, list_name)
    joined = joined.unionByName(part(False).select(*own, F.lit(None).cast(lists.schema[list_name].dataType).alias(list_name)))
    extra = [("n_lines", T.LongType()), ("n_removed", T.LongType()), ("removed_share", T.DoubleType())]
    schema = extended(docs, extra)

    def work(batches):
        for batch in chunks(batches, text_col):
            raw = as_bytes(batch.column(text_col))
            split = [t.split(b"\n") if t else [] for t in raw]
            told = [(i, r["line"], r["tell"]) for i, rs in enumerate(batch.column(list_name).to_pylist()) for r in rs or [] if r["line"] < len(split[i])]
            own = tells([split[i][n] for i, n, _ in told])
            out: list[set[int]] = [set() for _ in raw]
            for (i, n, want), got in zip(told, own.tolist(), strict=True):
                if got == want:
                    out[i].add(n)
            texts = [b"\n".join(x for n, x in enumerate(p) if n not in o) if o else t for t, p, o in zip(raw, split, out, strict=True)]
            counts, gone = [len(p) for p in split], [len(o) for o in out]
            share = [sum(len(p[n].split()) for n in o) / max(1, sum(len(x.split()) for x in p)) if o else 0.0 for p, o in zip(split, out, strict=True)]
            names = [n for n in batch.schema.names if n != list_name]
            changed = pa.array(texts, pa.binary()).cast(pa.string())
            columns = {n: changed if n == text_col else batch.column(n) for n in names}
            yield with_columns(pa.RecordBatch.from_arrays(list(columns.values()), names=names), {"n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed_share": pa.array(share, pa.float64())})

    return map_batches(joined, work, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """id -> deduplicated text by comparing each line with all earlier ones; for tests."""
    before: list[set] = []
    out = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").encode().split(b"\n"):
            w = set(line.lower().split())
            if not w or not any(100 * len(w & b) >= PERCENT * len(w | b) for b in before if 100 * min(len(w), len(b)) >= PERCENT * max(len(w), len(b))):
                kept.append(line)
            if w:
                before.append(w)
        out[i] = text if text is None else b"\n".join(kept).decode()
    return out
