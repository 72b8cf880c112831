"""A Katz backoff bigram model over words: learned, stored in partitioned tables, and evaluated on every text.

The chance of a word after another is its count, discounted by Good-Turing, over the count of the one before; what the
discounts free goes to the words never seen there, in proportion to their unigram chances, with a weight that makes the
chances of a context sum to one exactly. Unigrams are discounted alike, and what they free is the chance of an
unknown word. A text's first word follows the beginning of a text, and its end is a word.

Words are 64-bit hashes. Their counts are an ordinary aggregation. The most frequent words, a bounded number, go to
every task; counts of the others are brought to their occurrences by a shuffle. Then occurrences of bigrams meet by
context in partitions of bounded size, where a very frequent context is split by its words. A merged partition holds
each bigram once, with its count and the rows it occurs in, as a row of a stored table, and is scored on its own.
Occurrences travel as compressed arrays; sums of a row's logarithms come back the same way, by groups of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches, bytes_of, fold_of
from tickerloom.session import stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Codes of the end and the beginning of a text. Codes of words are ``SHORT`` or more; below it, from ``FIRST`` on, the
#: most frequent words have short codes, their places among them, so that packed occurrences take few bytes.
END, BEGIN, FIRST, SHORT = np.uint64(1), np.uint64(2), np.uint64(3), np.uint64(1 << 20)
#: Counts up to this are discounted.
SMALL = 5
#: Words that every task knows, occurrences that a map task packs at once, and that a partition holds.
HEAD_WORDS, PACK_TOKENS, PART_TOKENS = 1 << 18, 1 << 20, 1_500_000
#: Rows whose sums travel together, as a power of two.
GROUP_BITS = 12


def pack(*arrays: np.ndarray) -> bytes:
    data = pickle.dumps(arrays, 5)
    return pa.compress(data, codec="zstd", asbytes=True) + len(data).to_bytes(8, "little")


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    size = int.from_bytes(data[-8:], "little")
    return pickle.loads(pa.decompress(data[:-8], decompressed_size=size, codec="zstd", asbytes=True))


def codes_of(text: bytes) -> np.ndarray:
    """Codes of the words of a whole text, then of its end."""
    words = text.translate(_LOWER).split()
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append(np.where(code < SHORT, code + SHORT, code), END)


def mixed(code: np.ndarray) -> np.ndarray:
    x = (code ^ (code >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def discounts(counts: list[int]) -> np.ndarray:
    """Katz's factors for counts 1..k from how many types have the counts 1..k+1; entry 0 is unused.

    Groups of copies can leave a bump in the counts of counts that makes a factor leave (0, 1); then only the counts
    below it are discounted. If not even the count 1 gives a factor, half of a count of 1 is freed.
    """
    most = len(counts) - 1
    n = np.array([0, *counts], float)
    out = np.ones(most + 1)
    for k in range(most, 0, -1):
        if not all(n[1 : k + 2] > 0):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        factor = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - common) / (1 - common) if common < 1 else np.ones(k)
        if k == 1 and common < 1:
            factor = np.array([common])  # with one discounted count, the plain estimate
        if ((factor > 0) & (factor < 1)).all():
            out[1 : k + 1] = factor
            return out
    out[1] = 0.5
    return out


@dataclass
class Unigrams:
    """Totals, discounts, and the most frequent words. Its methods take short codes where they say so."""

    tokens: int
    types: int
    texts: int
    factor: np.ndarray
    unknown: float  # chance of an unknown word
    kept: float  # 1 unless no word is rare, when a share is kept for unknown words
    head: np.ndarray  # codes, sorted
    head_count: np.ndarray

    def chance(self, count: np.ndarray) -> np.ndarray:
        count = count.astype(float)
        small = np.minimum(count, SMALL + 1).astype(int)
        factor = np.append(self.factor, 1.0)[small]
        return np.where(count > 0, self.kept * factor * count / max(1, self.tokens), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def short(self, code: np.ndarray) -> np.ndarray:
        """Codes with the frequent words' codes made short."""
        if not len(self.head):
            return code
        at = np.minimum(np.searchsorted(self.head, code), len(self.head) - 1)
        return np.where(self.head[at] == code, at.astype(np.uint64) + FIRST, code)

    def look_up(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of frequent words, and which words are frequent."""
        known = (short >= FIRST) & (short < SHORT)
        count = np.zeros(len(short), np.int64)
        count[known] = self.head_count[(short[known] - FIRST).astype(np.int64)]
        return count, known

    def pieces(self, context: np.ndarray, part_tokens: int) -> np.ndarray:
        """Into how many pieces the occurrences of a context are split."""
        count, _ = self.look_up(context)
        count = np.where(context == BEGIN, self.texts, count)
        return 1 + 4 * count // part_tokens


@dataclass
class Bigrams:
    factor: np.ndarray
    split: dict[int, tuple[float, float, float]]  # contexts that are split: count, small counts' freed mass, seen chances


def leftover(count: np.ndarray, freed: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of the seen words and backoff weight of each context; their chances sum to one."""
    has = count > 0
    safe = np.where(has, count, 1)
    none = freed <= 1e-12 * safe  # no small count: a share like that of one more occurrence is kept for the others
    kept = np.where(none, safe / (safe + 1.0), 1.0)
    rest = np.where(none, 1.0 / (safe + 1.0), freed / safe)
    return np.where(has, kept, 1.0), np.where(has, rest / np.maximum(1e-300, 1 - seen), 1.0)


def _texts(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, training marks, word codes and their number per row, in packs of bounded size."""
    rows, train, codes, sizes, held = [], [], [], [], 0
    for batch in batches:
        for row, own, text in zip(batch.column("row").to_pylist(), batch.column("train").to_pylist(), bytes_of(batch), strict=True):
            code = codes_of(text)
            rows.append(row)
            train.append(own)
            codes.append(code)
            sizes.append(len(code))
            held += len(code)
            if held >= PACK_TOKENS:
                yield np.array(rows), np.array(train, bool), np.concatenate(codes), np.array(sizes)
                rows, train, codes, sizes, held = [], [], [], [], 0
    if rows:
        yield np.array(rows), np.array(train, bool), np.concatenate(codes), np.array(sizes)


def _count_words(batches: Batches) -> Iterator[pa.RecordBatch]:
    for _, _, codes, _ in _texts(batches):
        code, n = np.unique(codes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])


def _occurrences(uni: Unigrams, batches: Batches) -> Iterator[tuple[np.ndarray, ...]]:
    """Context, word, row and training mark of every occurrence, in short codes."""
    for rows, train, codes, sizes in _texts(batches):
        distinct, at = np.unique(codes, return_inverse=True)
        codes = uni.short(distinct)[at]
        context = np.r_[BEGIN, codes[:-1]]
        context[np.cumsum(sizes)[:-1]] = BEGIN
        yield context, codes, np.repeat(rows, sizes), np.repeat(train, sizes)


_PARTS = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
_PARTS_SQL = "part int, kind string, data binary"


def _packed(context: np.ndarray, word: np.ndarray, row: np.ndarray, train: np.ndarray, count: np.ndarray) -> bytes:
    """Occurrences in order of context and word. Counts are packed only for words that aren't frequent."""
    new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    sizes = np.diff(np.r_[new, len(context)]).astype(np.int32)
    base = row.min()
    mark = (row - base) << 1 | train
    mark = mark.astype(np.uint32) if mark.max() < 1 << 32 else mark
    rare = word >= SHORT
    return pack(context[new], sizes, word if rare.any() else word.astype(np.uint32), np.array([base]), mark, count[rare].astype(np.int32))


def _unpacked(uni: Unigrams, data: bytes) -> tuple[np.ndarray, ...]:
    context, sizes, word, base, mark, rare = unpack(data)
    word, mark = word.astype(np.uint64), mark.astype(np.int64)
    count, known = uni.look_up(word)
    if len(rare):
        count[~known] = rare
    return np.repeat(context, sizes), word, (mark >> 1) + base[0], (mark & 1).astype(bool), count


def _dealt(part: np.ndarray, kind: str, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Arrays cut by part, each cut packed, in batches of bounded bytes."""
    order = np.lexsort((arrays[1], arrays[0], part)) if kind != "count" else np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    out, held = [], 0
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = [x[a:b] for x in arrays]
        data = pack(*own) if kind == "count" else _packed(*own)
        out.append((int(part[a]), kind, data))
        held += len(data)
        if held > 4 << 20 or b == len(part):
            yield _rows(out)
            out, held = [], 0


def _rows(out: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS, strict=True)], schema=_PARTS)


def _sums(rows: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the values of each row, packed by groups of rows; the part is a hash of the group."""
    row, at = np.unique(rows, return_inverse=True)
    names = ("tokens", "known", "base", "score")
    total = [np.bincount(at, values[n], len(row)) if n in values else np.zeros(len(row), np.float32) for n in names]
    group = row >> GROUP_BITS
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(row) else np.zeros(1, int)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        place = (row[a:b] & ((1 << GROUP_BITS) - 1)).astype(np.uint16)
        out.append((0, "sum", group[a].astype(np.int64).tobytes() + pack(place, *(t[a:b] for t in total))))
    if out:
        yield _rows(out)


def _gather(batches: Batches) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True)


def _joined(packs: list[tuple], width: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in packs]) for i in range(width)]


def _context_part(uni: Unigrams, context: np.ndarray, word: np.ndarray, parts: int, part_tokens: int) -> np.ndarray:
    piece = mixed(word) % uni.pieces(context, part_tokens).astype(np.uint64)
    return (mixed(mixed(context) + piece) % np.uint64(parts)).astype(np.int64)


def _merge(uni: Unigrams, packs: list[tuple], part_tokens: int) -> Iterator[tuple[str, bytes]]:
    """Each bigram once, with its count, in one packed row; counts of counts; and what split contexts must add up."""
    context, word, row, train, count = _joined(packs, 5)
    order = np.lexsort((word, context))
    context, word, row, train, count = (a[order] for a in (context, word, row, train, count))
    new = np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(context)])
    times = np.add.reduceat(train.astype(np.int64), first)
    own, word_count = context[first], count[first]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    of = np.cumsum(np.r_[False, own[1:] != own[:-1]])
    small = np.stack([np.bincount(of, (times == r) * r, len(head)) for r in range(1, SMALL + 1)], axis=1)
    total = np.bincount(of, times, len(head))
    seen = np.bincount(of, np.where(times > 0, uni.chance(word_count), 0.0), len(head))
    code = own[head]
    split = uni.pieces(code, part_tokens) > 1
    yield "counts", pack(np.array([(times == r).sum() for r in range(1, SMALL + 2)]))
    if split.any():
        yield "split", pack(code[split], total[split], small[split], seen[split])
    yield "merged", pack(of.astype(np.int32), times.astype(np.int32), word_count, size.astype(np.int32), row, code, total, small, seen)


def _score(uni: Unigrams, bi: Bigrams, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows and log10 chances of all occurrences of a merged partition."""
    of, times, word_count, size, row, code, total, small, seen = unpack(data)
    freed = small @ (1 - bi.factor[1:])
    if bi.split:
        for i in np.flatnonzero(np.isin(code, np.array(list(bi.split), np.uint64))):
            total[i], freed[i], seen[i] = bi.split[int(code[i])]
    kept, back = leftover(total, freed, seen)
    factor = np.append(bi.factor, 1.0)[np.minimum(times, SMALL + 1)]
    found = kept[of] * factor * times / np.maximum(1, total[of])
    chance = np.where(times > 0, found, back[of] * uni.chance(word_count))
    return row, np.repeat(np.log10(chance), size)


def _learn_words(texts: DataFrame, head_words: int) -> tuple[DataFrame, Unigrams]:
    if head_words > int(SHORT - FIRST):
        raise ValueError(f"at most {SHORT - FIRST} words have short codes")
    counts = texts.filter("train").mapInArrow(_count_words, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = stored(counts, "katz-words")
    end = int(END)
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("types"),
        F.coalesce(F.sum(F.when(F.col("code") == end, F.col("n"))), F.lit(0)).alias("texts"),
        *[F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, SMALL + 2)],
    ).first()
    top = counts.orderBy(F.desc("n"), "code").limit(head_words).toArrow()
    code, n = top.column("code").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(code)
    few = [stats[f"n{r}"] for r in range(1, SMALL + 2)]
    factor = discounts(few)
    freed = sum(few[r - 1] * r * (1 - factor[r]) for r in range(1, SMALL + 1))
    tokens = stats.tokens
    kept, unknown = (tokens / (tokens + 1), 1 / (tokens + 1)) if freed <= 0 else (1.0, freed / tokens)
    return counts, Unigrams(tokens, stats.types, stats.texts, factor, unknown, kept, code[order], n[order])


def score_texts(
    docs: DataFrame,
    folds: int = 5,
    held_out: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every whole text.

    Gives ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with half a count added) and
    score, logarithms to base 10. A null text counts as empty and has its end as the only token; a null id is in fold 0;
    repeated rows are learned and scored each; other columns are ignored; an empty table gives no rows, and with
    nothing learned every word is unknown. ``docs`` must be a stored table, as its rows are numbered more than once.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text")
    ).withColumn("train", fold_of(F.col("id"), folds) != held_out)
    texts = numbered.select("row", "train", "text")
    counts, uni = _learn_words(texts, head_words)
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(uni)
    parts = max(-(-uni.tokens * folds // ((folds - 1) * part_tokens)), sc.defaultParallelism)

    # Rare words: their occurrences meet their counts.
    def rare(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = words.value
        for context, word, row, train in _occurrences(own, batches):
            count, known = own.look_up(word)
            yield from _sums(row, tokens=np.ones(len(row)), known=known.astype(float), base=np.where(known, own.base(count), 0.0))
            part = (mixed(word[~known]) % np.uint64(parts)).astype(np.int64)
            yield from _dealt(part, "rare", *(a[~known] for a in (context, word, row, train, count)))

    def rare_counts(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = words.value
        for batch in batches:
            code, n = batch.column("code").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            tail = own.short(code) >= SHORT
            yield from _dealt((mixed(code[tail]) % np.uint64(parts)).astype(np.int64), "count", code[tail], n[tail])

    def resolve(batches: Batches) -> Iterator[pa.RecordBatch]:
        own, known, open_packs = words.value, [], []  # all of one part
        for kind, data in _gather(batches):
            if kind == "sum":
                yield _rows([(0, kind, data)])
            else:
                (known.append(unpack(data)) if kind == "count" else open_packs.append(_unpacked(own, data)))
        if not open_packs:
            return
        context, word, row, train, _ = _joined(open_packs, 5)
        count = np.zeros(len(word), np.int64)
        if known:
            code, n = _joined(known, 2)
            order = np.argsort(code)
            code, n = code[order], n[order]
            at = np.minimum(np.searchsorted(code, word), len(code) - 1)
            count = np.where(code[at] == word, n[at], 0)
        yield from _sums(row, known=(count > 0).astype(float), base=own.base(count))
        part = _context_part(own, context, word, parts, part_tokens)
        yield from _dealt(part, "gram", context, word, row, train, count)

    met = texts.mapInArrow(rare, _PARTS_SQL).unionByName(counts.mapInArrow(rare_counts, _PARTS_SQL))
    spread = F.when(F.col("kind") == "sum", F.pmod(F.xxhash64("data"), F.lit(parts))).otherwise(F.col("part")).cast("int")
    resolved = stored(met.repartitionById(parts, spread).mapInArrow(resolve, _PARTS_SQL), "katz-rare")

    # All bigrams: merged by context.
    def common(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = words.value
        for context, word, row, train in _occurrences(own, batches):
            count, known = own.look_up(word)
            context, word, row, train, count = (a[known] for a in (context, word, row, train, count))
            part = _context_part(own, context, word, parts, part_tokens)
            yield from _dealt(part, "gram", context, word, row, train, count)

    def merge(batches: Batches) -> Iterator[pa.RecordBatch]:
        packs = [_unpacked(words.value, data) for _, data in _gather(batches)]
        if packs:
            yield _rows([(0, kind, data) for kind, data in _merge(words.value, packs, part_tokens)])

    grams = texts.mapInArrow(common, _PARTS_SQL).unionByName(resolved.filter("kind = 'gram'"))
    merged = stored(grams.repartitionById(parts, F.col("part")).mapInArrow(merge, _PARTS_SQL), "katz-bigrams")
    bigrams = sc.broadcast(_learn_bigrams(merged))

    # Scores: each merged row on its own; sums by row.
    def score(batches: Batches) -> Iterator[pa.RecordBatch]:
        rows, values, held = [], [], 0
        for _, data in _gather(batches):
            row, value = _score(words.value, bigrams.value, data)
            rows.append(row)
            values.append(value)
            held += len(row)
            if held > 2 * PART_TOKENS:
                yield from _sums(np.concatenate(rows), score=np.concatenate(values))
                rows, values, held = [], [], 0
        if rows:
            yield from _sums(np.concatenate(rows), score=np.concatenate(values))

    scored = merged.filter("kind = 'merged'").mapInArrow(score, _PARTS_SQL)
    sums = resolved.filter("kind = 'sum'").unionByName(scored)
    grouped = sums.select(F.substring("data", 1, 8).alias("rows"), "data").groupBy("rows")
    added = grouped.applyInArrow(_add, "row long, n_tokens long, n_known long, base_score double, score double")
    return (
        numbered.select("row", "id")
        .join(added, "row")
        .select(
            F.col("id").alias(id_col),
            (fold_of(F.col("id"), folds) == held_out).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(uni.tokens).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )


def _learn_bigrams(merged: DataFrame) -> Bigrams:
    """Discounts, and totals of the contexts that are split; these are a few for each partition at most."""
    few = np.zeros(SMALL + 1, np.int64)
    split: dict[int, list] = {}
    for r in merged.filter("kind IN ('counts', 'split')").select("kind", "data").toLocalIterator():
        if r.kind == "counts":
            few += unpack(bytes(r.data))[0]
            continue
        for code, total, small, seen in zip(*unpack(bytes(r.data)), strict=True):
            known = split.setdefault(int(code), [0.0, np.zeros(SMALL), 0.0])
            split[int(code)] = [known[0] + total, known[1] + small, known[2] + seen]
    factor = discounts(few.tolist())
    return Bigrams(factor, {c: (t, float(s @ (1 - factor[1:])), seen) for c, (t, s, seen) in split.items()})


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of a group of rows from all parts."""
    size = 1 << GROUP_BITS
    total, there = np.zeros((4, size)), np.zeros(size, bool)
    for data in table.column("data").to_pylist():
        place, *values = unpack(data[8:])
        there[place] = True
        for k, v in enumerate(values):
            total[k, place] += v
    at = np.flatnonzero(there)
    first = int.from_bytes(key[0].as_py(), "little", signed=True) << GROUP_BITS
    return pa.table(
        {
            "row": first + at,
            "n_tokens": np.rint(total[0, at]).astype(np.int64),
            "n_known": np.rint(total[1, at]).astype(np.int64),
            "base_score": total[2, at],
            "score": total[3, at],
        }
    )
