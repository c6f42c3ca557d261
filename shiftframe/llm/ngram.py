"""Language-model scores from a weighted backoff automaton over all n-grams of the corpus.

Texts are cut into blocks of bounded size that name their words by numbers of their own. Words are counted over all
blocks and every block gets the counts of its words back, so no table of all words has to fit anywhere. Every word is a
state: its arcs are all pairs that it begins, however rare, weighted by discounted relative counts, and its failure arc
leads to the root, whose arcs are the discounted counts of single words and of the unknown word. Pairs are counted in
parts, dealt by their words, and every block gets the counts of its own pairs back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.toxicity import fold

BLOCK_TOKENS = 2_000_000
BLOCK_TEXTS = 8192
PART_TOKENS = 4_000_000  # pairs that are counted by one task at most, all blocks together, on average
CROWDED = 4  # a word with more than a part's tokens divided by this is dealt over several parts
BELOW = 0.75  # fixed value: what an arc's count gives to the failure arc
PRIOR = 0.1  # fixed value: what the base adds to every count
END = "\n"  # stands for the end of a text; no word holds white space
BLOCK_TYPE = "block long, doc_ids array<{id}>, train array<boolean>, lengths array<int>, tokens binary, words array<string>, counts array<long>"


def tokens_of(text: str | None) -> list[str]:
    """Words of a whole text with A-Z lower-cased, split at ASCII white space only."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def blocks(docs: DataFrame, key: str, text: str, folds: int) -> DataFrame:
    """Texts as numbers, many to a row: a block ends at ``BLOCK_TOKENS`` tokens or ``BLOCK_TEXTS`` texts.

    Numbers rise with falling frequency in the block, which packs well. ``counts`` covers training texts only.
    """
    train = F.coalesce(fold(F.col(key), folds) != 0, F.lit(True))
    narrow = docs.select(F.col(key).alias("doc_id"), train.alias("train"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()

    def closed(number: int, ids: list, trained: list, texts: list[list[int]], words: dict[bytes, int]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], dtype=np.int32)
        flat = np.fromiter((x for t in texts for x in t), dtype=np.int32, count=int(lengths.sum()))
        size = np.bincount(flat, minlength=len(words))
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(words), dtype=np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        flat = place[flat]
        counts = np.bincount(flat[np.repeat(np.array(trained, dtype=bool), lengths)], minlength=len(words))
        names = list(words)
        packed = zstandard.ZstdCompressor(level=1).compress(flat.tobytes())
        columns = [
            pa.array([number]), pa.array([ids], pa.list_(id_type)), pa.array([trained]), pa.array([lengths]),
            pa.array([packed], pa.binary()), pa.array([[names[i].decode("utf-8", "surrogatepass") for i in order]], pa.list_(pa.string())),
            pa.array([counts.astype(np.int64)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "train", "lengths", "tokens", "words", "counts"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        end = END.encode()
        ids, trained, texts, words, total = [], [], [], {end: 0}, 0
        for batch in found:
            for doc_id, is_train, content in zip(*batch.columns):
                raw = (content.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                raw.append(end)
                texts.append([words.setdefault(w, len(words)) for w in raw])
                ids.append(doc_id.as_py())
                trained.append(is_train.as_py())
                total += len(raw)
                if total >= BLOCK_TOKENS or len(texts) >= BLOCK_TEXTS:
                    yield closed(number, ids, trained, texts, words)
                    number += 1
                    ids, trained, texts, words, total = [], [], [], {end: 0}, 0
        if texts:
            yield closed(number, ids, trained, texts, words)

    return narrow.mapInArrow(batches, BLOCK_TYPE.format(id=kind))


def unpacked(tokens: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), dtype=np.int32)


def packed(x: np.ndarray) -> bytes:
    """An array of 64-bit integers with bytes of equal weight side by side, which packs well."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked_longs(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.int64)


@dataclass
class Totals:
    """Training tokens, different words among them, and what the root takes from every word for the unknown one."""

    total: int
    distinct: int
    discount: float

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words with these counts at the root; zero means unknown."""
        if not self.total:
            return np.zeros(len(counts))
        mass = np.where(counts > 0, counts - self.discount, self.discount * self.distinct)
        return np.log10(mass / self.total)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + PRIOR) / (self.total + PRIOR * (self.distinct + 1)))


@dataclass
class Automaton(Totals):
    """The states that some texts reach, with their weighted arcs and failure arcs.

    ``arcs`` holds ``state * states + word`` in order, ``weights`` their log10 probabilities, ``failure`` the log10
    weight of leaving each state for the root. ``states`` names the states where they have names.
    """

    states: dict[str, int]
    arcs: np.ndarray
    weights: np.ndarray
    failure: np.ndarray

    def traverse(self, states: np.ndarray, at_root: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of each token on one walk from left to right.

        ``states`` is the state that each token leads to (-1: the root), ``at_root`` its weight there, ``begins``
        marks first tokens. A token is read along an arc of the state before it, or else that state's failure arc is
        taken and the token read at the root. The state after a token depends on the token alone, so the whole walk
        is known beforehand and its steps are taken together.
        """
        before = np.concatenate([[-1], states[:-1]])
        before[begins] = -1
        result = at_root.copy()
        inside = before >= 0
        result[inside] += self.failure[before[inside]]
        both = np.flatnonzero(inside & (states >= 0))
        if len(both) and len(self.arcs):
            wanted = before[both].astype(np.int64) * len(self.failure) + states[both]
            place = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            hit = self.arcs[place] == wanted
            result[both[hit]] = self.weights[place[hit]]
        return result


def automaton(sums: Totals, size: np.ndarray, followers: np.ndarray, arc: np.ndarray, n: np.ndarray, states: dict[str, int] | None = None) -> Automaton:
    """Automaton of states with these counts and numbers of different followers, and of arcs in order with theirs."""
    # every training token but the ends is followed by one, so the arcs' counts add up to the state's
    failure = np.log10(np.where(followers > 0, BELOW * followers / np.maximum(size, 1), 1.0))
    of, to = np.divmod(arc, max(len(size), 1))
    # an arc has its discounted share and, through the failure arc, its part of what was set free
    weights = np.log10((n - BELOW) / size[of] + 10.0 ** failure[of] * 10.0 ** sums.root(size)[to]) if len(arc) else np.zeros(0)
    return Automaton(sums.total, sums.distinct, sums.discount, states or {}, arc, weights, failure)


def totals(counts: DataFrame) -> Totals:
    """Totals of ``word, n`` for all words of all blocks."""
    sums = counts.where("n > 0").agg(
        F.sum("n"), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
    ).first()
    total, distinct, once, twice = (x or 0 for x in sums)
    return Totals(int(total), int(distinct), float(once / (once + 2 * twice) if once and twice else 0.5))


def block_pairs(tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``first * words + second`` in order, count in training texts) of the pairs whose first word has a ``size``."""
    at = np.ones(max(len(tokens) - 1, 0), dtype=bool)
    at[np.cumsum(lengths)[:-1] - 1] = False
    at &= size[tokens[:-1]] > 0
    learned = np.repeat(train, lengths)[:-1][at]
    mark = np.sort((tokens[:-1][at].astype(np.int64) * len(size) + tokens[1:][at]) * 2 + learned)
    starts = np.flatnonzero(np.diff(mark >> 1, prepend=-1))
    return mark[starts] >> 1, np.add.reduceat(mark & 1, starts) if len(starts) else np.zeros(0, dtype=np.int64)


def build_automaton(stored: DataFrame, counts: DataFrame) -> Automaton:
    """The whole automaton over the training texts in ``stored`` blocks, given ``word, n`` for all their words.

    All of it comes to the driver, so this is for a small corpus; ``score_texts`` builds each block's part of it.
    """
    sums = totals(counts)
    size = {r["word"]: r["n"] for r in counts.where("n > 0").orderBy("word").collect()}
    states = {word: i for i, word in enumerate(size)}
    found: dict[int, int] = {}
    for row in stored.select("train", "lengths", "tokens", "words").toLocalIterator():
        state = np.array([states.get(w, -1) for w in row["words"]])
        pairs, n = block_pairs(unpacked(row["tokens"]), np.array(row["lengths"]), np.array(row["train"]), state + 1)
        first, second = np.divmod(pairs[n > 0], len(state))
        for arc, times in zip((state[first] * len(states) + state[second]).tolist(), n[n > 0].tolist()):
            found[arc] = found.get(arc, 0) + times
    arc = np.array(sorted(found), dtype=np.int64)
    followers = np.bincount(arc // max(len(states), 1), minlength=len(states))
    return automaton(sums, np.array([*size.values()], dtype=np.int64), followers, arc, np.array([found[x] for x in arc.tolist()]), states)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Dealer:
    """Which part counts a pair. Pairs of one first word share a part, unless the word is crowded."""

    parts: int
    total: int

    def shares(self, size: np.ndarray) -> np.ndarray:
        """Number of parts over which the pairs of words with these counts are dealt."""
        return np.maximum(1, np.minimum(self.parts, size.astype(float) * CROWDED * self.parts / max(self.total, 1)).astype(np.int64))

    def deal(self, pairs: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """(number of parts per word, (part, places in ``pairs``) of every part that has some), in order."""
        shares, hashed = self.shares(size), mixed(ids)
        first, second = np.divmod(pairs, max(len(ids), 1))
        part = (hashed[first] // np.uint64(3) + hashed[second] % shares[first].astype(np.uint64)) % np.uint64(self.parts)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
        return shares, [(int(part[at[0]]), at) for at in np.split(order, starts[1:]) if len(at)]


def runs(first: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.diff(first, prepend=-1))


def counted_pairs(numbered: DataFrame, dealer: Dealer) -> DataFrame:
    """``block, part, n, followers``: for the pairs that a block sent to a part, their counts over all blocks, and for
    each of their first words the number of different words that follow it in that part.

    Rows with block -1 hold in ``n`` the crowded words of a part and in ``followers`` their numbers there.
    """

    def dealt(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                ids, size = unpacked_longs(row["ids"]), unpacked_longs(row["sizes"])
                pairs, n = block_pairs(unpacked(row["tokens"]), np.array(row["lengths"]), np.array(row["train"]), size)
                shares, places = dealer.deal(pairs, ids, size)
                for part, at in places:
                    first, second = np.divmod(pairs[at], len(ids))
                    starts = runs(first)
                    own = first[starts]
                    columns = [ids[own], np.diff(starts, append=len(at)), shares[own] > 1, ids[second], n[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([row["block"]]), *[pa.array([packed(x)], pa.binary()) for x in columns]],
                        names=["part", "block", "words", "runs", "crowded", "seconds", "n"],
                    )

    def counted(part: tuple, group: pa.Table) -> pa.Table:
        read = lambda name: [unpacked_longs(x) for x in group.column(name).to_pylist()]
        words, lengths, seconds = read("words"), read("runs"), read("seconds")
        names, word = np.unique(np.concatenate(words), return_inverse=True)
        others, second = np.unique(np.concatenate(seconds), return_inverse=True)
        pairs, place = np.unique(np.repeat(word, np.concatenate(lengths)) * len(others) + second, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(read("n")), minlength=len(pairs)).astype(np.int64)
        followers = np.bincount(pairs[n > 0] // len(others), minlength=len(names))
        crowded = np.unique(word[np.concatenate(read("crowded")) > 0])
        pair_ends, word_ends = np.cumsum([len(x) for x in seconds])[:-1], np.cumsum([len(x) for x in words])[:-1]
        rows_n = [packed(x) for x in np.split(n[place], pair_ends)] + [packed(names[crowded])]
        rows_followers = [packed(x) for x in np.split(followers[word], word_ends)] + [packed(followers[crowded])]
        return pa.table({
            "block": pa.array([*group.column("block").to_pylist(), -1], pa.int64()),
            "part": pa.array([part[0].as_py()] * len(rows_n), pa.int32()),
            "n": pa.array(rows_n, pa.binary()), "followers": pa.array(rows_followers, pa.binary()),
        })

    sent = numbered.select("block", "train", "lengths", "tokens", "ids", "sizes").mapInArrow(
        dealt, "part int, block long, words binary, runs binary, crowded binary, seconds binary, n binary"
    )
    return sent.groupBy("part").applyInArrow(counted, "block long, part int, n binary, followers binary")


def crowded_followers(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Crowded words in order and their followers over all parts. There are fewer than ``CROWDED`` to a part."""
    found: dict[int, int] = {}
    for row in counted.where("block = -1").select("n", "followers").toLocalIterator():
        for word, followers in zip(unpacked_longs(row["n"]).tolist(), unpacked_longs(row["followers"]).tolist()):
            found[word] = found.get(word, 0) + followers
    return np.array(sorted(found), dtype=np.int64), np.array([found[x] for x in sorted(found)], dtype=np.int64)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learns from all rows whose fold is not 0. A null or empty text is its end alone. A null id is never held out.
    Repeated rows are learned from and scored each. An empty table gives no rows. Without training rows both scores
    treat every token as unknown. Other columns are not read.
    """
    stored = materialize(blocks(docs, key, text, folds), "text-blocks")
    words = stored.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select(
        "block", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n")
    )
    summed = words.groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(summed.withColumn("id", F.monotonically_increasing_id()), "word-counts")
    sums = totals(counts)
    tokens = stored.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    dealer = Dealer(max(1, -(-tokens // PART_TOKENS)), sums.total)

    def named(block: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("at").to_numpy())
        longs = lambda name: pa.array([packed(group.column(name).to_numpy()[order])], pa.binary())
        return pa.table({"of_block": pa.array([block[0].as_py()], pa.int64()), "ids": longs("id"), "sizes": longs("n")})

    returned = words.select("block", "at", "word").join(counts, "word").select(F.col("block").alias("of_block"), "at", "n", "id")
    names = materialize(returned.groupBy("of_block").applyInArrow(named, "of_block long, ids binary, sizes binary"), "block-words")
    numbered = stored.drop("words", "counts").join(names, F.col("block") == F.col("of_block")).drop("of_block")
    counted = materialize(counted_pairs(numbered, dealer), "pair-counts")
    crowded, crowded_by = crowded_followers(counted)
    kind = docs.schema[key].dataType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        ids, size = unpacked_longs(row["ids"]), unpacked_longs(row["sizes"])
        lengths, tokens = np.array(row["lengths"], dtype=np.int64), unpacked(row["tokens"])
        pairs, _ = block_pairs(tokens, lengths, np.array(row["train"]), size)
        n, followers = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        told = {x["part"]: x for x in right.to_pylist()}
        shares, places = dealer.deal(pairs, ids, size)
        for part, at in places:
            first = pairs[at] // len(ids)
            n[at] = unpacked_longs(told[part]["n"])
            followers[first[runs(first)]] = unpacked_longs(told[part]["followers"])
        many = np.flatnonzero(shares > 1)
        many = many[np.isin(ids[many], crowded)]  # the end of a text has no followers
        followers[many] = crowded_by[np.searchsorted(crowded, ids[many])]
        model = automaton(sums, size, followers, pairs[n > 0], n[n > 0])
        begins = np.cumsum(lengths) - lengths
        state = np.where(size > 0, np.arange(len(size)), -1)
        weight = model.traverse(state[tokens], model.root(size)[tokens], begins)
        add = lambda x: np.add.reduceat(x, begins)  # noqa: E731 - every text has its end, so no length is zero
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], left.schema.field("doc_ids").type.value_type),
            "held_out": pa.array([not x for x in row["train"]]),
            "n_tokens": lengths,
            "n_known": add((size[tokens] > 0).astype(np.int64)),
            "train_tokens": np.full(len(lengths), model.total, dtype=np.int64),
            "base_score": add(model.base(size)[tokens]),
            "score": add(weight),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return (
        numbered.select("block", "doc_ids", "train", "lengths", "tokens", "ids", "sizes").groupBy("block")
        .cogroup(counted.where("block >= 0").withColumnRenamed("block", "of_block").groupBy("of_block")).applyInArrow(scored, schema)
    )
