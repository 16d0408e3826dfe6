"""Toxicity by a weighted lexicon: texts are folded (compatibility forms, homoglyphs, digits inside words), matched by an Aho-Corasick
automaton, exception phrases cancel the matches inside them, and the summed weights are normalised by length.

The lexicon (whole words and word beginnings with weights), exception phrases and the score's scale are learned from labelled rows:
at most ``per_label`` rows of each label, dealt by a hash of doc_id, less confirmed copies. That bound is the only one; every text is scored whole.

Defined results: null and empty texts score 0; without usable labels the lexicon is empty and every score is 0; of several labels of one
document the toxic one counts; a null ``doc_id`` is scored, but never learned from and never held out; repeated rows give repeated rows;
no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillset.llm.near_dedup import near_duplicates
from quillset.llm.shared import Scratch, outside, own_columns
from quillset.session import BATCH_ROWS

# Letters of other scripts that look like Latin ones, and digits and signs written for letters. As 1 stands for i and for l,
# l itself folds to i.
HOMOGLYPHS = dict(zip("аеорсухіѕјкмтвнԁԛԝαεορτυικνχ", "aeopcyxisjkmtbhdqwaeoptuikvx", strict=True)) | dict(zip("һӏѵɡıɑօսհ", "hivgiaouh", strict=True)) | {"l": "i"}
LOOKALIKES = dict(zip("0134578@$|", "oieastbasi", strict=True))
FOLD, IN_WORD = str.maketrans(HOMOGLYPHS), str.maketrans(LOOKALIKES)
SUBSTITUTE, WORD = re.compile(r"[0134578@$|]"), re.compile(r"[^\W\d_]+")
# Characters that are not drawn, and accents of Latin, Greek and Cyrillic letters: neither may part or change a word.
UNSEEN = re.compile("[\u00ad\u0300-\u036f\u061c\u115f\u1160\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
AROUND = ".,;:!?\"'()[]{}<>*#&%-_/\\"
PREFIXES, MIN_WORD, EXTRA_WORDS, LEAST_RATIO = range(4, 9), 3, 20, 5
TABLE_TOKENS, TABLE_TOKEN_CHARS = 150_000, 64


class FoldTable(dict):
    """White-space token -> its folded words; each distinct token is folded once. Emptied when full, so memory stays bounded."""

    def __missing__(self, token: str) -> str:
        if token.isascii() and token.isalpha():
            folded = token.lower().replace("l", "i")  # what the lines below come to for plain words
        else:
            folded = self._folded(token)
        if len(self) >= TABLE_TOKENS:
            self.clear()
        if len(token) <= TABLE_TOKEN_CHARS:
            self[token] = folded
        return folded

    @staticmethod
    def _folded(token: str) -> str:
        if not token.isascii():
            token = UNSEEN.sub("", unicodedata.normalize("NFKD", token))
        text = unicodedata.normalize("NFKC", token).casefold().strip(AROUND)
        if SUBSTITUTE.search(text) and WORD.search(text):
            text = text.translate(IN_WORD)
        return " ".join(WORD.findall(text.translate(FOLD)))


TABLE = FoldTable()


def fold(text: str) -> tuple[str, int]:
    """Folded words, each between single spaces, and their number."""
    folded = " ".join(filter(None, map(TABLE.__getitem__, text.split())))
    return f" {folded} ", folded.count(" ") + bool(folded)


@dataclass(frozen=True)
class Lexicon:
    """``weights``: folded " word " or " beginning" -> weight; ``exceptions``: folded phrases; ``allowance``: summed weight that a text of
    any length may hold; ``scale``: rate at which the score is one half."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    allowance: float = 0.0
    scale: float = 1.0

    def rate(self, weight: float, words: int) -> float:
        return max(0.0, weight - self.allowance) / (words + EXTRA_WORDS)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found if len(found) else None

    def score(self, rate: float) -> float:
        return rate / (rate + self.scale) if rate else 0.0


def matches(text: str, automaton) -> tuple[list[tuple[int, float]], int]:
    """(start, weight) of the lexicon matches of a text outside exception phrases, and its number of words."""
    folded, words = fold(text)
    if automaton is None or not words:
        return [], words
    hits, covered = {}, []
    for end, (size, weight) in automaton.iter(folded):
        if weight:
            hits[end - size + 1] = (end, weight)  # of entries that begin one word the longest counts: it ends last
        else:
            covered.append((end - size + 1, end))
    free = outside([(s, e) for s, (e, _) in hits.items()], covered)
    return [(s, w) for s, (e, w) in hits.items() if (s, e) in free], words


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """doc_id, toxic, text of at most ``per_label`` rows of each label (two bounded top-k selections of ids), texts not null."""
    marked = own_columns(labels, doc_id="doc_id", toxic="toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("doc_id"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [marked.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    texts = own_columns(docs, doc_id="doc_id", text="text").filter("text IS NOT NULL")
    return texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")


def _distinct_contents(sample: DataFrame) -> DataFrame:
    """Copies would make every word of a copied text look telling: of equal texts of one label, and of texts of one label linked by at least
    85 % of their five-word shingles (confirmed on full sets), the one with the smallest doc_id is kept. All other rows stay."""
    texts = sample.groupBy("toxic", "text").agg(F.min(F.col("doc_id").cast("bigint")).alias("doc_id"))
    groups = near_duplicates(texts).select("doc_id", "component_id")
    labels = texts.select("doc_id", "toxic").join(groups, "doc_id")
    kept = labels.groupBy("component_id", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    return texts.join(kept, ["doc_id", "toxic"], "left_semi")


def _entry_counts(sample: DataFrame) -> DataFrame:
    """For all words and word beginnings: toxic and clean documents that have them, and how often they stand there; tasks send partial counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, uses = (Counter(), Counter()), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            entries = list(docs[0].keys() | docs[1].keys())
            columns = {"entry": entries, "clean": docs[0], "toxic": docs[1], "clean_uses": uses[0], "toxic_uses": uses[1]}
            out = pa.RecordBatch.from_pydict({n: c if c is entries else [c[e] for e in entries] for n, c in columns.items()})
            for counter in (*docs, *uses):
                counter.clear()
            return out

        for batch in batches:
            for toxic, value in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                seen: Counter = Counter()
                for w, n in Counter(fold(value.as_py())[0].split()).items():
                    if len(w) >= MIN_WORD:
                        seen[f" {w} "] = n
                    for k in PREFIXES:
                        if k < len(w):
                            seen[f" {w[:k]}"] += n
                docs[toxic].update(seen.keys())
                uses[toxic].update(seen)
                if len(docs[0]) + len(docs[1]) > 200_000:
                    yield flush()
        if docs[0] or docs[1]:
            yield flush()

    parts = sample.select("toxic", "text").mapInArrow(work, "entry string, clean bigint, toxic bigint, clean_uses bigint, toxic_uses bigint")
    return parts.groupBy("entry").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]])


def _surprise(a: float, t: int, c: float, n: int) -> float:
    """Log-likelihood ratio of an entry in a of t toxic and c of n clean documents against one common share."""
    term = lambda k, m, p: (k * math.log(k / m / p) if k else 0) + ((m - k) * math.log((m - k) / m / (1 - p)) if m - k else 0)
    p = (a + c) / (t + n)
    return 2 * (term(a, t, p) + term(c, n, p)) if 0 < p < 1 else 0.0


def choose_entries(rows: list[tuple], toxic: int, clean: int, candidates: int, words: tuple[int, int]) -> dict[str, float]:
    """Entries whose share among toxic documents is beyond chance for so many candidates, from the most telling on;
    a longer beginning of an entry's words is added only if it tells more, a shorter one only if it reaches more documents.

    rows: (entry, toxic documents, clean documents, uses in toxic, uses in clean); words: of all toxic and all clean documents. The weight
    is the log ratio of how densely an entry stands in them; below LEAST_RATIO it is left out.
    """
    least = 2 * math.log(max(candidates, 2)) + 6
    ranked = sorted(((_surprise(a, toxic, c, clean), e, a, u, v) for e, a, c, u, v in rows), key=lambda r: (-r[0], -len(r[1]), r[1]))
    chosen: dict[str, float] = {}
    reached: dict[str, int] = {}
    for surprise, entry, a, u, v in ranked:
        if surprise < least:
            break
        weight = math.log(((u + 0.5) / (words[0] + 1)) / ((v + 0.5) / (words[1] + 1)))
        longer = any(entry.startswith(o) and weight < w + math.log(2) for o, w in chosen.items())
        shorter = any(o.startswith(entry) and a < 1.2 * reached[o] for o in chosen)
        if weight >= math.log(LEAST_RATIO) and not longer and not shorter:
            chosen[entry], reached[entry] = weight, a
    return chosen


def _found(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """toxic, summed weight, number of words and, for every match, the phrases made of its word and a neighbour."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            weights, counts, phrases = [], [], []
            for value in batch.column("text"):
                folded, _ = fold(value.as_py())
                hits, words = matches(value.as_py(), automaton)
                weights.append(sum(w for _, w in hits))
                counts.append(words)
                found = set()
                for start, _ in hits:
                    stop = folded.index(" ", start + 1)
                    found.add(folded[max(folded.rfind(" ", 0, start), 0) : stop + 1])
                    found.add(folded[start : folded.find(" ", stop + 1) + 1 or len(folded)])
                phrases.append(sorted(p for p in found if len(p.split()) == 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(weights, pa.float64()), pa.array(counts, pa.int64()), pa.array(phrases, pa.list_(pa.string()))],
                names=["toxic", "weight", "words", "phrases"],
            )

    return sample.select("toxic", "text").mapInArrow(work, "toxic int, weight double, words bigint, phrases array<string>")


def best_cut(rates: list[tuple[int, float]]) -> tuple[float, float]:
    """(mean of both recalls, cut): the rate that parts the labels best, midway on a log scale to the next lower rate."""
    toxic, clean = sum(t for t, _ in rates), sum(1 - t for t, _ in rates)
    ordered = sorted({r for _, r in rates if r > 0}, reverse=True)
    if not toxic or not clean or not ordered:
        return 0.5, 1.0
    at: dict[float, list[int]] = {}
    for t, r in rates:
        at.setdefault(r, [0, 0])[t] += 1
    best, cut, hit, false = -1.0, ordered[0], 0, 0
    for i, r in enumerate(ordered):
        hit, false = hit + at[r][1], false + at[r][0]
        value = hit / toxic - false / clean
        if value > best:
            below = ordered[i + 1] if i + 1 < len(ordered) else r / 4
            best, cut = value, math.sqrt(r * max(below, r / 4))
    return (best + 1) / 2, cut


def learn_lexicon(docs: DataFrame, labels: DataFrame, per_label: int = 6000, predicted_at: float = 0.7, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit on labelled rows that are not held out; ``exceptions`` adds phrases of your own to the learned ones."""
    scratch = Scratch(docs.sparkSession, "toxicity", BATCH_ROWS)
    sample = scratch.store(_distinct_contents(scratch.store(_sample(docs, labels, per_label), "sample")), "distinct")
    size = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = size.get(1, 0), size.get(0, 0)
    mine = tuple(fold(e)[0] for e in exceptions)
    if not toxic or not clean:
        return Lexicon({}, mine)
    counts = scratch.store(_entry_counts(sample), "counts")
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    telling = counts.filter((F.col("toxic") >= 3) & (share("clean", clean) * 3 <= share("toxic", toxic)))
    top = telling.orderBy(F.desc("toxic"), "clean", "entry").limit(20_000).select("entry", "toxic", "clean", "toxic_uses", "clean_uses").collect()
    whole = counts.filter(F.col("entry").endswith(" ")).agg(F.count("*"), F.sum("toxic_uses"), F.sum("clean_uses")).first()
    weights = choose_entries([tuple(r) for r in top], toxic, clean, whole[0], (whole[1] or 0, whole[2] or 0))
    if not weights:
        return Lexicon({}, mine)
    found = scratch.store(_found(sample, Lexicon(weights, mine)), "found")
    phrases = found.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # A phrase that stands again and again in clean documents and hardly ever in toxic ones excuses the words in it.
    learned = phrases.filter((F.col("c") >= 8) & (F.col("t") * clean * 5 < F.col("c") * toxic)).orderBy(F.desc("c"), "phrase").limit(2000)
    excused = tuple(r["phrase"] for r in learned.collect())
    if excused:
        found = scratch.store(_found(sample, Lexicon(weights, mine + excused)), "found-again")
    rows = [tuple(r) for r in found.select("toxic", "weight", "words").collect()]  # at most 2 * per_label
    middle = sorted(weights.values())[len(weights) // 2]
    tried = []
    for allowance in (0.0, middle, 2 * middle):  # how much of a chance match a text may hold is learned too
        shape = Lexicon(weights, mine + excused, allowance)
        tried.append((*best_cut([(t, shape.rate(w, n)) for t, w, n in rows]), allowance))
    _, cut, allowance = max(tried, key=lambda t: t[0])
    scratch.forget("sample", "distinct", "counts", "found", "found-again")
    return Lexicon(weights, mine + excused, allowance, cut * (1 - predicted_at) / predicted_at)


def score_documents(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with score, rate, n_hits and n_words for every whole text; labels, lang and source are never read."""
    columns = own_columns(docs, **{c: c for c in dict.fromkeys((*keep, "text"))})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for value in batch.column("text"):
                hits, words = matches(value.as_py() or "", automaton)
                rate = lexicon.rate(sum(w for _, w in hits), words)
                for column, v in zip(out, (lexicon.score(rate), rate, len(hits), words), strict=True):
                    column.append(v)
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=[*keep, "score", "rate", "n_hits", "n_words"])

    kept = ", ".join(f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in keep)
    return columns.mapInArrow(work, f"{kept}, score double, rate double, n_hits bigint, n_words bigint")
