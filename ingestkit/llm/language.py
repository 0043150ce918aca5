"""Language ID: a linear-chain conditional random field over the words of a text.

Every word gets a label (a language); its features are its affixes, its character n-grams and, for each language,
whether it is in that language's lexicon. Weights of features and of transitions between neighbouring labels are learned
together by maximum likelihood; forward-backward gives every word its distribution over languages, so code-switched
texts are labelled word by word. A text's language is the one with the greatest share of its words' probability.

Training takes a sample of bounded size from every language there is: at most ``DOCS`` labelled documents of each, the
first by hash, and fewer of each where more than ``LANGUAGES`` languages share ``LANGUAGES * DOCS`` documents, but never none.
Documents of more than ``MAX_CHARS`` characters come after the others and give a window of that size from their first letter.
Documents carry one label, so sentences that switch are composed from spans of several languages; that is what transitions
are learned from. Their number grows with the languages.
Lexica are the words of the sample that belong to one language nine times out of ten.

Prediction reads texts whole. Blocks of the documents of one batch are labelled side by side, one position at a time;
emissions are computed once per distinct word and kept in a cache of bounded size.

Cases: null or empty text and text without a letter is ``und`` with score 0 and no labels; equal scores go to the first
language by name; repeated rows get equal answers; without any labelled document every text is ``und``; an empty table
gives no rows; a null label or id trains nothing and is predicted like any other.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, lean, others

DOCS, MAX_CHARS, LANGUAGES, FEATURE_BITS, CACHE, BLOCK, CELLS = 150, 20_000, 64, 16, 300_000, 128, 1 << 24
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FEATURE_BITS)


def _gram_slots(codes: np.ndarray, at: np.ndarray, n: int, kind: int) -> np.ndarray:
    h = np.full(len(at), np.uint64(kind))
    for k in range(n):
        h = h * np.uint64(1_000_003) + codes[at + k]
    return _mix(h)


@dataclass
class Tagger:
    languages: list[str]
    lexicon: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def features(self, words: list[str], lexicon: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """``(word number, slot)`` of all features: affixes of 1 to 3 letters, n-grams of 2 and 3 letters with the word's
        ends marked, the language whose lexicon has the word, and a constant."""
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) for w in words])
        starts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1])).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes + 2)
        owners, slots = [np.arange(len(words))], [np.full(len(words), _mix(np.array([1], np.uint64))[0])]
        for n in (2, 3):
            at = np.flatnonzero(word[:len(word) - n + 1] == word[n - 1:])
            owners.append(word[at])
            slots.append(_gram_slots(codes, at, n, 10 + n))
        for n in (1, 2, 3):
            long = np.flatnonzero(sizes >= n)
            owners += [long, long]
            slots += [_gram_slots(codes, starts[long] + 1, n, 20 + n), _gram_slots(codes, starts[long] + 1 + sizes[long] - n, n, 30 + n)]
        if lexicon and self.lexicon:
            home = np.array([self.lexicon.get(w, -1) for w in words])
            known = np.flatnonzero(home >= 0)
            owners.append(known)
            slots.append(_mix((home[known] + 100).astype(np.uint64)))
        return np.concatenate(owners), np.concatenate(slots).astype(np.int64)

    def scores(self, words: list[str]) -> np.ndarray:
        owner, slot = self.features(words)
        return _sums(owner, self.emit[slot], len(words))


def _sums(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, rows[:, k], n) for k in range(rows.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word and expected transitions. ``scores``: words of all sequences one after another.

    Sequences are cut into blocks of ``BLOCK`` words that are worked on side by side. The product of a block's steps is a
    small matrix; those products carry the forward and backward vectors over the borders, so long texts stay exact.
    """
    m = np.exp(move)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    count = -(-lengths // BLOCK)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # of a block in its sequence
    start = np.repeat(begins, count) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(begins + lengths, count) - start)
    order = np.argsort(-size, kind="stable")
    back = np.argsort(order)
    start, size, number = start[order], size[order], number[order]
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]  # blocks longer than t
    first = number == 0
    states = len(m)

    def norm(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    step = np.broadcast_to(np.eye(states), (len(start), states, states)).copy()
    if count.max() > 1:
        for t, n in enumerate(running):
            moved = step[:n] @ m
            if t == 0:
                moved[first[:n]] = step[:n][first[:n]]
            moved *= e[start[:n] + t][:, None, :]
            step[:n] = moved / moved.max(axis=(1, 2), keepdims=True)
    incoming, outgoing = np.ones((len(start), states)), np.ones((len(start), states))
    heads = np.cumsum(count) - count
    for j in range(1, int(count.max())):
        here = np.flatnonzero(count > j)
        now, before = back[heads[here] + j], back[heads[here] + j - 1]
        incoming[now] = norm(np.einsum("ij,ijk->ik", incoming[before], step[before]))
    for j in range(int(count.max()) - 1, 0, -1):
        here = np.flatnonzero(count > j)
        now, before = back[heads[here] + j], back[heads[here] + j - 1]
        outgoing[before] = norm(np.einsum("ijk,ik->ij", step[now], outgoing[now]))
    forward, backward = np.empty_like(e), np.empty_like(e)
    a = incoming
    for t, n in enumerate(running):
        at = start[:n] + t
        a = a[:n] @ m
        if t == 0:
            a[first[:n]] = 1.0
        a = norm(a * e[at])
        forward[at] = a
    for t in range(len(running) - 1, -1, -1):
        n, further = running[t], running[t + 1] if t + 1 < len(running) else 0
        at = start[:n] + t
        b = outgoing[:n].copy()
        if further:
            after = at[:further] + 1
            b[:further] = norm((e[after] * backward[after]) @ m.T)
        backward[at] = b
    marginal = norm(forward * backward)
    inner = np.ones(len(e), bool)
    inner[begins] = False
    after = np.flatnonzero(inner)
    right = e[after] * backward[after]
    total = np.einsum("ti,ij,tj->t", forward[after - 1], m, right, optimize=True)
    return marginal, m * (forward[after - 1].T @ (right / total[:, None]))


def train(rows: list[tuple[str, str]], rounds: int = 60, sequences: int = 400, length: int = 60) -> Tagger:
    """``(text, language)`` of the sample → a tagger. The order of the rows decides nothing but ties of the draw."""
    texts = [(words_of(t), lang) for t, lang in rows]
    languages = sorted({lang for w, lang in texts if w})
    index = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, Counter] = {}
    for words, lang in texts:
        for w in words:
            counts.setdefault(w, Counter())[lang] += 1
    lexicon = {w: index[top] for w, c in counts.items() for top, n in c.most_common(1) if n >= 3 and n >= 0.9 * sum(c.values())}
    tagger = Tagger(languages, lexicon, np.zeros((1 << FEATURE_BITS, len(languages))), np.zeros((len(languages),) * 2))
    if not languages:
        return tagger
    random = np.random.Generator(np.random.PCG64(7))
    pools = [[w for w, lang in texts if w and lang == name] for name in languages]
    sentences = []
    for k in range(max(sequences, 6 * len(languages))):  # every language begins some
        words, labels = [], []
        while len(words) < length:
            label = int(random.integers(len(languages))) if words else k % len(languages)
            source = pools[label][int(random.integers(len(pools[label])))]
            begin, span = int(random.integers(len(source))), int(random.integers(3, 40))
            words += source[begin:begin + span]
            labels += [label] * len(source[begin:begin + span])
        sentences.append((words[:length], labels[:length]))
    vocabulary = sorted({w for s, _ in sentences for w in s})
    place = {w: k for k, w in enumerate(vocabulary)}
    # a word's lexicon is hidden in half of its places, so that unseen words are learned from as well
    size = len(vocabulary)
    owner, flat = tagger.features(vocabulary)
    hidden_owner, hidden = tagger.features(vocabulary, lexicon=False)
    owner, flat = np.concatenate((owner, hidden_owner + size)), np.concatenate((flat, hidden))
    used, flat = np.unique(flat, return_inverse=True)
    ids = np.array([place[w] for s, _ in sentences for w in s])
    ids = ids + size * random.integers(0, 2, len(ids))
    gold = np.zeros((len(ids), len(languages)))
    labels = np.array([x for _, ls in sentences for x in ls])
    gold[np.arange(len(ids)), labels] = 1
    gold_moves = np.zeros((len(languages),) * 2)
    inner = np.arange(len(labels)) % length > 0
    np.add.at(gold_moves, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    lengths = np.full(len(sentences), length)
    weights, moves = np.zeros((len(used), len(languages))), np.zeros_like(gold_moves)
    seen, seen_moves = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(rounds):  # AdaGrad on the whole sample
        word_scores = _sums(owner, weights[flat], 2 * size)
        marginal, expected = forward_backward(word_scores[ids], lengths, moves)
        pull = _sums(ids, gold - marginal, 2 * size)
        slope = _sums(flat, pull[owner], len(used))
        slope -= 0.1 * weights
        turn = gold_moves - expected - 0.1 * moves
        seen += slope ** 2
        seen_moves += turn ** 2
        weights += 0.5 * slope / np.sqrt(seen)
        moves += 0.5 * turn / np.sqrt(seen_moves)
    tagger.emit[used] = weights
    tagger.move[:] = moves
    return tagger


class Emissions:
    """Scores of the distinct words met so far, forgotten when there are more than ``CACHE`` (fewer beyond 16 languages)."""

    def __init__(self, tagger: Tagger) -> None:
        self.tagger, self.place, self.rows = tagger, {}, np.empty((0, len(tagger.languages)))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.place) * max(1.0, len(self.tagger.languages) / 16) > CACHE:
            self.place, self.rows = {}, self.rows[:0]
        known = self.place
        unseen = [w for w in dict.fromkeys(words) if w not in known]
        if unseen:
            known.update(zip(unseen, range(len(known), len(known) + len(unseen))))
            self.rows = np.concatenate((self.rows, self.tagger.scores(unseen)))
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def label(emissions: Emissions, texts: list[list[str]]) -> list[np.ndarray]:
    """Marginals per word of every text, in order of the texts."""
    out = [np.empty((0, len(emissions.tagger.languages)))] * len(texts)
    order = [k for k, t in enumerate(texts) if t]
    if order and emissions.tagger.languages:
        lengths = np.array([len(texts[k]) for k in order])
        scores = emissions([w for k in order for w in texts[k]])
        marginal, _ = forward_backward(scores, lengths, emissions.tagger.move)
        for k, part in zip(order, np.split(marginal, np.cumsum(lengths)[:-1])):
            out[k] = part
    return out


def training_rows(docs: DataFrame, docs_per_language: int = DOCS, max_chars: int = MAX_CHARS, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """The bounded sample: the first documents of each language by hash that are not held out, shorter ones before windows of
    longer ones. ``languages`` is how many share the sample before each gives fewer documents."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
                        & F.col("text").rlike(r"\p{L}"))
    share = languages * docs_per_language // max(1, usable.select("lang").distinct().count())
    each = max(1, min(docs_per_language, share))
    long = F.length("text") > max_chars
    window = F.when(long, F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0)).otherwise(F.col("text"))
    picked = usable.select("doc_id", "lang", long.alias("_long"), F.xxhash64("doc_id", "text").alias("_h"), window.alias("text"))
    order = Window.partitionBy("lang").orderBy("_long", "_h", "doc_id")
    ranked = picked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each)
    return [(r[0], r[1]) for r in ranked.orderBy("lang", "_r").select("text", "lang").collect()]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spans: bool = True,
             batch_words: int = 200_000) -> DataFrame:
    """Per row of ``docs``: ``doc`` (the row as a struct), ``lang_pred``, ``score``, ``languages`` (words per label, a map) and,
    if asked for, ``spans``: runs of words of one label with their first and last word number."""
    tagger = train(training_rows(fields(docs, doc_id=id_col, text=text_col, lang=lang_col)))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(tagger))  # 2^FEATURE_BITS weights per language, a bounded lexicon

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pickle.loads(shared.value)
        emissions, cells = Emissions(made), len(made.languages) ** 2
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            begin = 0
            while begin < len(batch):
                words, total, end = [], 0, begin
                while end < len(batch) and total < batch_words and (total / BLOCK + end - begin) * cells < CELLS:
                    words.append(words_of(texts[end].as_py()))
                    total += len(words[-1])
                    end += 1
                yield _answers(made, batch.slice(begin, end - begin), words, label(emissions, words), spans)
                begin = end

    source = docs.select(others(docs, text_col).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))
    schema = (f"_rest {source.schema['_rest'].dataType.simpleString()}, _text string, lang_pred string, score double, "
              "languages map<string,bigint>, spans array<struct<label:string,first:bigint,last:bigint>>")
    doc = F.struct(*[(F.col("_text") if c == text_col else F.col("_rest").getField(c)).alias(c) for c in docs.columns])
    return source.mapInArrow(step, schema).select(doc.alias("doc"), "lang_pred", "score", "languages", *(["spans"] if spans else []))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def _answers(made: Tagger, batch: pa.RecordBatch, words: list[list[str]], marginals: list[np.ndarray], spans: bool) -> pa.RecordBatch:
    names, scores, counts, runs = [], [], [], []
    for text, p in zip(words, marginals):
        if not len(p):
            names.append("und")
            scores.append(0.0)
            counts.append([])
            runs.append([])
            continue
        share = p.mean(axis=0)
        best = int(share.argmax())
        names.append(made.languages[best])
        scores.append(float(min(1.0, share[best])))
        labels = p.argmax(axis=1)
        tally = np.bincount(labels, minlength=len(made.languages))
        counts.append([(made.languages[k], int(n)) for k, n in enumerate(tally) if n])
        edges = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)])) if spans else [0]
        runs.append([{"label": made.languages[labels[a]], "first": int(a), "last": int(b) - 1} for a, b in zip(edges[:-1], edges[1:])])
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()),
         pa.array(counts, pa.map_(pa.string(), pa.int64())), pa.array(runs, _SPANS)],
        names=[*batch.schema.names, "lang_pred", "score", "languages", "spans"])


def identify_digest(docs: DataFrame) -> DataFrame:
    return identify(docs.select("doc_id", "text", "lang"), spans=False).select(
        "doc.doc_id", F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
