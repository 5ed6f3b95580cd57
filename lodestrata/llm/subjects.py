"""Subject areas of documents (problem 10).

The document-term matrix is factored by seeded non-negative alternating
updates: one component per subject, anchored by labelled samples, and one for
what belongs to no subject. In turn, the mixture of each document is solved for
the present components (multiplicative updates), and the components are solved
for the mixtures of all documents; terms that no subject owns clearly fall to
the background. The anchored components then yield the mixture of each sentence
in the same way, and the sentences that a subject has its share of make up the
mixture of the document.

Texts are read once, into hashes of their words; all else runs on arrays of
numbers. Components hold the ``HELD`` most frequent terms on every worker. The
others get their part of each subject from the mixtures by an aggregation, and
come to the sentences by a join, so that no term is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

#: Terms that the components hold in memory; the rest is joined.
HELD = 300_000
#: Documents' worth of a term, each damped, below which it says nothing.
SUPPORT = 3.0
#: Alternating updates of all documents and, in each, of a document's mixture.
ROUNDS, STEPS = 3, 6
#: How far from an even share to all of a term's mass its subject must hold, and weight of the labelled samples in each update.
OWNED, ANCHOR = 0.45, 0.3
#: Terms of a sentence that the part of its subject must come to (a word with the pairs it is in counts up to three), and its part of what all subjects have of it.
EVIDENCE, CLEAR = 1.5, 0.5
#: Cells of the matrix that are solved at once.
CELLS = 50_000

_SENTENCE = re.compile(r"[.!?。！？][\"'”»)\]]*(?=\s)|[\r\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_FOLD = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("’", "'"))
_MANY, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_DOC_BITS = np.uint64(20)
#: Words of the texts that are worked on at once, but for a longer text.
WORDS = 400_000


def sentences(text: str, name: str | None = None) -> Iterator[list[str]]:
    """Words of each sentence and list item; headings, addresses, table rules and pieces without two words are none.

    ``name`` is the text's publisher, whose name may spell a subject: its words don't count.
    """
    low = text.lower()
    if name and len(name.strip()) >= 3:
        low = low.replace(name.strip().lower(), "¤")
    if not low.isascii():
        for a, b in _FOLD:
            low = low.replace(a, b)
    find = _TOKEN.findall
    for s in _SENTENCE.split(low):
        s = s.strip(" \t\r\n*•>|-")
        if s and s[0] != "#" and not s.startswith(("http://", "https://")):
            found = find(s)
            if len(found) >= 2:
                yield found


class Hasher(dict):
    """Word -> number of 64 bits; 0 for single letters. Forgets all once it holds half a million."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1 if len(word) > 1 else 0
        return got


def hashed(texts: Iterable[tuple[str, str | None]], known: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words per sentence, sentences per text) of texts, one after the other."""
    found: list[str] = []
    sizes: list[int] = []
    per_text: list[int] = []
    for text, name in texts:
        before = len(sizes)
        for s in sentences(text, name):
            sizes.append(len(s))
            found += s
        per_text.append(len(sizes) - before)
    words, each = np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)).view(np.uint64), np.array(sizes, dtype=np.int64)
    some = words != 0
    kept = np.r_[0, np.cumsum(some)]
    ends = np.cumsum(each)
    return words[some], kept[ends] - kept[ends - each], np.array(per_text, dtype=np.int64)


def terms_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs of neighbouring words as (term, sentence)."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(of[1:] == of[:-1])
    a, b = words[inside], words[inside + 1]
    pairs = a * _MANY + (b ^ (b >> np.uint64(29))) * _OTHER
    return np.concatenate([words, pairs]), np.concatenate([of, of[inside]])


def term_numbers(words: list[str]) -> np.ndarray:
    """Terms of one sentence given by its words."""
    known = Hasher()
    got = np.array([k for w in words if (k := known[w])], dtype=np.int64).view(np.uint64)
    return terms_of(got, np.array([len(got)]))[0]


@dataclass
class Cells:
    """Terms of documents with weights that damp repeats, so that one very long document can't outweigh the others; ordered by term."""

    #: Distinct terms, and the first cell of each.
    terms: np.ndarray
    first: np.ndarray
    #: Of each cell its term's place in ``terms``, its document and its weight.
    term: np.ndarray
    doc: np.ndarray
    x: np.ndarray


def document_cells(terms: np.ndarray, doc: np.ndarray) -> Cells:
    """Cells of up to a million documents; terms whose last 44 bits are equal are told apart no further within them."""
    key = (terms << _DOC_BITS) | doc.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    x = np.log2(1.0 + np.diff(np.r_[at, len(key)])).astype(np.float32)
    same = key[at] >> _DOC_BITS
    first = np.flatnonzero(np.r_[len(same) > 0, same[1:] != same[:-1]])
    own = order[at]
    return Cells(terms[own[first]], first, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(same)])), doc[own], x)


def _read(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words, sizes, sentences per row) of parsed texts, whose columns ``words`` and ``sizes`` stand at ``column``; some ``WORDS`` words at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column + 1)
        per_row = np.diff(sizes.offsets.to_numpy())
        each = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sentence_at = np.r_[0, np.cumsum(per_row)]
        word_at = np.r_[0, np.cumsum(each)][sentence_at]
        blobs = batch.column(column)
        for lo, hi in _runs(np.diff(word_at), WORDS):
            lengths = np.diff(word_at[lo : hi + 1]) * 8
            parts = [np.frombuffer(codec.decompress(blob.as_buffer(), int(n)), dtype=np.uint64) for blob, n in zip(blobs[lo:hi], lengths) if n]
            yield batch.slice(lo, hi - lo), np.concatenate(parts) if parts else np.zeros(0, np.uint64), each[sentence_at[lo] : sentence_at[hi]], per_row[lo:hi]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items with ``most`` in all or, where one item has more, little above."""
    ends = np.cumsum(sizes)
    if len(ends):
        cuts = np.unique(np.r_[0, (np.searchsorted(ends, np.arange(most, ends[-1], most)) + 1).clip(0, len(ends)), len(ends)])
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def parse(src: DataFrame) -> DataFrame:
    """(id, words, sizes) of ``src`` (id, text, name): hashes of words, compressed, and the words of each sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codec = Hasher(), pa.Codec("zstd", compression_level=1)
        for batch in batches:
            words, sizes, per_text = hashed(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), known)
            at, word_at = np.r_[0, np.cumsum(per_text)], np.r_[0, np.cumsum(sizes)]
            blobs = [codec.compress(words[word_at[a] : word_at[b]].tobytes(), asbytes=True) for a, b in zip(at[:-1], at[1:])]
            listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sizes, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), listed], names=["id", "words", "sizes"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, words binary, sizes array<int>")


def _row_cells(words: np.ndarray, sizes: np.ndarray, per_row: np.ndarray) -> Cells:
    terms, sentence = terms_of(words, sizes)
    return document_cells(terms, np.repeat(np.arange(len(per_row)), per_row)[sentence])


def term_weights(parsed: DataFrame) -> DataFrame:
    """(term, n): summed weight of each term over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            terms, back = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x for _, x in held]))
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n, pa.float64())], names=["term", "n"])

        for _, words, sizes, per_row in _read(batches, 0):
            c = _row_cells(words, sizes, per_row)
            if len(c.terms):
                held.append((c.terms, np.add.reduceat(c.x.astype(np.float64), c.first)))
                size += len(c.terms)
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return parsed.select("words", "sizes").mapInArrow(run, "term long, n double").groupBy("term").agg(F.sum("n").alias("n"))


def mixtures(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative mixtures (rows, components) of the rows of a sparse matrix, none of them empty, by multiplicative updates.

    ``at`` (components, cells) has each cell's probability in every component.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    w = np.full((len(at), len(starts)), 1.0 / len(at), dtype=np.float32)
    mass = np.add.reduceat(x, starts)
    for _ in range(steps):
        fit = np.zeros(len(x), dtype=np.float32)
        for p, v in zip(at, w):
            fit += p * v.take(of)
        ratio = x / np.maximum(fit, 1e-12)
        for p, v in zip(at, w):
            v *= np.add.reduceat(p * ratio, starts)
        w /= mass
    return w.T


@dataclass
class Components:
    """Probabilities of each of ``terms`` (sorted) and, in a last column, of a term that no subject owns: in every subject and, last, in the background."""

    subjects: list[str]
    terms: np.ndarray
    #: (components, terms + 1)
    table: np.ndarray
    #: Terms that a subject owns.
    owned: np.ndarray

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term, -1 for one that isn't held."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        k = np.searchsorted(self.terms, terms).clip(0, len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def solve(self, row: np.ndarray, cell: np.ndarray, x: np.ndarray, plain: np.ndarray, n_rows: int, table: np.ndarray | None = None) -> np.ndarray:
        """Mixtures of ``n_rows`` rows over the subjects; 0 for a row without cells.

        Cells that a subject owns are given by row, column of the table and weight. Terms
        that none owns have the same proportions in all components, so that ``plain``,
        their summed weight by row, is one cell more, in the last column.
        """
        table = self.table if table is None else table
        out = np.zeros((n_rows, len(self.subjects)), dtype=np.float32)
        n = np.bincount(row, minlength=n_rows)
        more = np.flatnonzero((n > 0) & (plain > 0))
        row, cell, x = np.r_[row, more], np.r_[cell, np.full(len(more), len(self.terms))], np.r_[x, plain[more]].astype(np.float32)
        order = np.argsort(row.astype(np.uint16) if n_rows <= 1 << 16 else row, kind="stable")
        cell, x = cell[order], x[order]
        some = np.flatnonzero(n)
        n[more] += 1
        sizes = n[some]
        ends = np.cumsum(sizes)
        for lo, hi in _runs(sizes, CELLS):
            a, b = ends[lo] - sizes[lo], ends[hi - 1]
            out[some[lo:hi]] = mixtures(ends[lo:hi] - sizes[lo:hi] - a, sizes[lo:hi], np.take(table, cell[a:b], axis=1), x[a:b])[:, :-1]
        return out

    def judge(self, row: np.ndarray, cell: np.ndarray, plain: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """The subject of each sentence, -1 for none, by its mixture; a sentence without an owned term has none."""
        w = self.solve(row, cell, np.ones(len(row), dtype=np.float32), plain, len(plain), table)
        n = np.bincount(row, minlength=len(plain)) + plain
        best = w.argmax(1)
        top = w[np.arange(len(w)), best]
        return np.where((top * n >= EVIDENCE) & (top >= CLEAR * w.sum(1)), best, -1)

    def subject(self, text: str) -> str | None:
        """The subject of one sentence by the held terms."""
        terms = np.concatenate([term_numbers(w) for w in sentences(text)] or [np.zeros(0, np.uint64)])
        k = self.find(terms)
        k = k[k >= 0]
        mine = k[self.owned[k]]
        got = self.judge(np.zeros(len(mine), dtype=np.int64), mine, np.array([len(k) - len(mine)]))[0]
        return self.subjects[got] if got >= 0 else None


def _owned(mass: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """``mass`` where one subject holds a term clearly beyond its size, else 0."""
    lifted = mass / np.maximum(prior[:, None], 1e-9)
    share = lifted / np.maximum(lifted.sum(0), 1e-12)
    return np.where((share >= _least_share(len(mass))) & (mass >= 1.0), mass * share, 0.0)


def _least_share(subjects: int) -> float:
    return 1 / max(1, subjects) + OWNED * (1 - 1 / max(1, subjects))


def _components(subjects: list[str], terms: np.ndarray, subject: np.ndarray, counts: np.ndarray) -> Components:
    """The subjects with a trace of everything, then the background."""
    total = counts.sum()
    rows = subject / np.maximum(subject.sum(1, keepdims=True), 1e-12)
    background = counts * (1 - np.minimum(0.98, subject.sum(0) / np.maximum(counts, 1e-9)))
    rest = max(background.sum(), 1e-12)
    plain = np.r_[np.full(len(subjects), 0.02 / total), 1 / rest]
    h = np.vstack([0.98 * rows + 0.02 * counts / total, background / rest])
    return Components(subjects, terms, np.column_stack([h, plain]).astype(np.float32), subject.sum(0) > 0)


def _subject_parts(model: Components, c: Cells, k: np.ndarray, n_rows: int) -> np.ndarray:
    """Part of each subject in each document's held terms, ``k`` being their places; documents with little of any subject have little."""
    place = k[c.term]
    mine = np.flatnonzero((place >= 0) & model.owned[place])
    others = (place >= 0) & ~model.owned[place]
    plain = np.bincount(c.doc[others], c.x[others], n_rows)
    w = model.solve(c.doc[mine], place[mine], c.x[mine], plain, n_rows)
    mass = w.sum(1, keepdims=True)
    return w / np.maximum(mass, 1e-9) * np.minimum(1.0, 10 * mass)


def _subject_sums(shared):
    """Mass of each held term by subject: the transposed mixtures times the matrix, over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Components = shared.value
        total = np.zeros((len(model.terms), len(model.subjects)))
        for _, words, sizes, per_row in _read(batches, 0):
            c = _row_cells(words, sizes, per_row)
            if len(c.terms):
                k = model.find(c.terms)
                w = _subject_parts(model, c, k, len(per_row))
                held = k >= 0
                for n in range(len(model.subjects)):
                    total[k[held], n] += np.add.reduceat(w[:, n].take(c.doc) * c.x, c.first)[held]
        t, s = np.nonzero(total > 1e-3)
        yield pa.RecordBatch.from_arrays([pa.array(t * len(model.subjects) + s, pa.int64()), pa.array(total[t, s], pa.float64())], names=["cell", "mass"])

    return run


def _rare_sums(shared):
    """(term, subject, mass) of terms that aren't held; subject -1 has all of a term's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Components = shared.value
        for _, words, sizes, per_row in _read(batches, 0):
            c = _row_cells(words, sizes, per_row)
            if not len(c.terms):
                continue
            k = model.find(c.terms)
            w = _subject_parts(model, c, k, len(per_row))
            rare = np.flatnonzero(k < 0)
            mass = np.add.reduceat(w[c.doc] * c.x[:, None], c.first)[rare]
            n = np.add.reduceat(c.x, c.first)[rare]
            r, s = np.nonzero(mass > 0.05)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[c.terms[rare], c.terms[rare][r]].view(np.int64)), pa.array(np.r_[np.full(len(rare), -1), s], pa.int32()), pa.array(np.r_[n, mass[r, s]].astype(np.float64))],
                names=["term", "subject", "mass"],
            )

    return run


@dataclass
class Fitted:
    model: Components
    #: Subjects' sizes and all weight of the components, which scale a rare term's probabilities.
    size: np.ndarray
    subject_total: np.ndarray
    background_total: float
    total: float
    #: Whether there are terms of enough support beyond those held.
    more: bool

    def rare_rows(self, mass: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, owned) of rare terms with these masses (terms, subjects) and weights."""
        own = _owned(mass.T, self.size / self.size.sum()).T
        own = np.minimum(own, n[:, None])
        rows = 0.98 * own / np.maximum(self.subject_total, 1e-12) + 0.02 * n[:, None] / self.total
        rest = n * (1 - np.minimum(0.98, own.sum(1) / np.maximum(n, 1e-9))) / max(self.background_total, 1e-12)
        return np.column_stack([rows, rest]).astype(np.float32), own.sum(1) > 0


def fit(parsed: DataFrame, labelled: Iterable[tuple[str, str]], held: int = HELD) -> Fitted | None:
    """Components for parsed texts: labelled (subject, text) anchor them, all rows of ``parsed`` shape them."""
    labelled = [(s, t) for s, t in labelled if s and t]
    subjects = sorted({s for s, _ in labelled})
    counted = cut(term_weights(parsed).where(F.col("n") >= SUPPORT))
    sizes = {r.b: r.n for r in counted.groupBy(F.floor(4 * F.log2("n")).alias("b")).agg(F.count("*").alias("n")).collect()}
    floor, room = None, held
    for b in sorted(sizes, reverse=True):
        room -= sizes[b]
        if room < 0:
            break
        floor = b
    rows = (counted.where(F.floor(4 * F.log2("n")) >= floor) if floor is not None else counted.limit(0)).toArrow()
    kept = dict(zip(rows.column("term").to_numpy().view(np.uint64).tolist(), rows.column("n").to_numpy().tolist()))
    seeds: dict[tuple[str, int], int] = {}
    for s, text in labelled:
        for w in sentences(text):
            for t in set(term_numbers(w).tolist()):
                seeds[s, t] = seeds.get((s, t), 0) + 1
    terms = np.array(sorted({*kept, *(t for _, t in seeds)}), dtype=np.uint64)
    if not len(terms):
        return None
    index = {t: k for k, t in enumerate(terms.tolist())}
    counts = np.array([kept.get(t, 1.0) for t in terms.tolist()])
    seed = np.zeros((len(subjects), len(terms)))
    for (s, t), n in seeds.items():
        seed[subjects.index(s), index[t]] = n
    prior = np.maximum(seed.sum(1), 1e-9)
    anchor = _owned(seed, prior / prior.sum())
    anchor *= np.where(seed.sum(0) >= 2, 1.0, 0.3)
    anchor_rows = anchor / np.maximum(anchor.sum(1, keepdims=True), 1e-12)
    subject = anchor_rows * (counts[None, :] * anchor_rows).sum(1, keepdims=True)
    subject = np.where(anchor > 0, np.minimum(counts, np.maximum(subject, 1.0)), 0.0)
    sc = parsed.sparkSession.sparkContext
    size = prior
    for _ in range(ROUNDS):
        shared = sc.broadcast(_components(subjects, terms, subject, counts))
        cells = parsed.select("words", "sizes").mapInArrow(_subject_sums(shared), "cell long, mass double").groupBy("cell").agg(F.sum("mass").alias("mass")).toArrow()
        shared.destroy()
        mass = np.zeros(seed.size)
        mass[cells.column("cell").to_numpy()] = cells.column("mass").to_numpy()
        mass = mass.reshape(seed.shape[::-1]).T
        size = np.maximum(mass.sum(1), 1.0)
        shaped = _owned(mass, size / size.sum())
        shaped /= np.maximum(shaped.sum(1, keepdims=True), 1e-12)
        subject = np.minimum(((1 - ANCHOR) * shaped + ANCHOR * anchor_rows) * size[:, None], counts[None, :])
    background = (counts * (1 - np.minimum(0.98, subject.sum(0) / np.maximum(counts, 1e-9)))).sum()
    return Fitted(_components(subjects, terms, subject, counts), size, subject.sum(1), float(background), float(counts.sum()), sum(sizes.values()) > len(kept))


def _rare_terms(parsed: DataFrame, fitted: Fitted, shared) -> DataFrame:
    """(key, rare): for each text with terms that aren't held but owned by a subject, [(term, probabilities)]."""
    k = len(fitted.model.subjects)
    sums = parsed.select("words", "sizes").mapInArrow(_rare_sums(shared), "term long, subject int, mass double").groupBy("term", "subject").agg(F.sum("mass").alias("mass"))
    by_term = sums.groupBy("term").agg(F.max(F.when(F.col("subject") < 0, F.col("mass"))).alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("subject") >= 0, F.struct("subject", "mass")))).alias("parts")).where(F.col("n") >= SUPPORT)
    wide = by_term.select("term", "n", F.array(*[F.coalesce(F.col("parts")[s], F.lit(0.0)) for s in range(k)]).alias("mass"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            p, owned = fitted.rare_rows(mass, batch.column(1).to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(owned)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(list(p[keep]), pa.list_(pa.float32()))], names=["term", "p"])

    owned = wide.mapInArrow(rows, "term long, p array<float>")

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Components = shared.value
        for batch, words, sizes, per_row in _read(batches, 1):
            c = _row_cells(words, sizes, per_row)
            rare = np.flatnonzero((model.find(c.terms) < 0)[c.term]) if len(c.terms) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.doc[rare], pa.int64())), pa.array(c.terms[c.term[rare]].view(np.int64))], names=["key", "term"])

    used = parsed.select("key", "words", "sizes").dropDuplicates(["key"]).mapInArrow(uses, "key long, term long")
    return used.join(owned, "term").groupBy("key").agg(F.collect_list(F.struct("term", "p")).alias("rare"))


def document_subjects(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = "company", subject_col: str = "subject", sample_col: str = "sample_text", fit_rows: int = 5000, held: int = HELD) -> DataFrame:
    """(id, subject, n_sentences, share) of each subject in a document's mixture: the part of its sentences that it has.

    * Null, empty and blank texts, and those without a sentence on a subject, give no row.
    * Every row of ``df`` is judged on its own, repeats and null ids included; whole texts are read.
    * ``fit_rows`` bounds the labelled samples (by text order); all texts of ``df`` take
      part in the factorisation. Without samples or texts there are no rows.
    * ``held`` bounds the terms in memory. Others count as well; only in the mixtures of
      whole documents, while the components are shaped, they take no part.
    * ``name_col`` may hold the publisher's name, which is not read as a topic; other columns are not read.
    """
    labelled = samples.select(subject_col, sample_col).where(F.col(subject_col).isNotNull() & F.col(sample_col).isNotNull()).orderBy(sample_col, subject_col).limit(fit_rows).collect()
    out = f"id {dict(df.dtypes)[id_col]}, subject string, n_sentences int, share double"
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")).alias("name")).where("text is not null")
    none = df.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    if not labelled:
        return none
    parsed = cut(parse(src))
    fitted = fit(parsed, [(r[0], r[1]) for r in labelled], held)
    if fitted is None:
        return none
    shared = df.sparkSession.sparkContext.broadcast(fitted.model)
    rows = parsed.withColumn("rare", F.lit(None).cast("array<struct<term: bigint, p: array<float>>>"))
    if fitted.more:
        keyed = parsed.withColumn("key", F.xxhash64("words", "sizes"))
        rows = keyed.join(_rare_terms(keyed, fitted, shared), "key", "left").select("id", "words", "sizes", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Components = shared.value
        for batch, words, sizes, per_row in _read(batches, 1):
            terms, sentence = terms_of(words, sizes)
            named, back = np.unique(terms, return_inverse=True)
            k = model.find(named)[back]
            mine = np.flatnonzero((k >= 0) & model.owned[k])
            plain = np.bincount(sentence[(k >= 0) & ~model.owned[k]], minlength=len(sizes))
            row, cell, columns = sentence[mine], k[mine], None
            extra = {t["term"]: t["p"] for r in batch.column(3).to_pylist() if r for t in r}
            if extra:
                names = np.array(sorted(extra), dtype=np.int64)
                p = np.array([extra[t] for t in names.tolist()], dtype=np.float32)
                order = np.argsort(names.view(np.uint64))
                names, p = names.view(np.uint64)[order], p[order]
                rest = np.flatnonzero(k < 0)
                j = np.searchsorted(names, terms[rest]).clip(0, len(names) - 1)
                met = names[j] == terms[rest]
                row, cell, columns = np.r_[row, sentence[rest[met]]], np.r_[cell, len(model.terms) + 1 + j[met]], np.hstack([model.table, p.T])
            subject = model.judge(row, cell, plain, columns)
            doc = np.repeat(np.arange(len(per_row)), per_row)
            some = subject >= 0
            cell, n = np.unique(doc[some] * len(model.subjects) + subject[some], return_counts=True)
            doc, s = np.divmod(cell, len(model.subjects))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array([model.subjects[i] for i in s], pa.string()), pa.array(n, pa.int32()), pa.array(n / per_row[doc])], names=["id", "subject", "n_sentences", "share"]
            )

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
