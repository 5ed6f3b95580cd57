"""Broken prompt and response pairs (problem 6).

Every pair gets at most one defect. Copies are found by aligning the tokens of
both sides (shingle containment and longest common subsequence), refusals by
aligning every sentence with refusal templates, whose places are filled by any
word of a class, empty answers by what is left without markup and labels. The
language of a text comes from a naive Bayes model over character trigrams and
words that is fitted on labelled passages. An answer closed with an ellipsis
breaks off; whether one without a final mark does is read from the corpus: how
often its last words end a sentence there, against how often they go on.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")

# Words that stand for no content, and labels before an answer.
PLACEHOLDERS = frozenset("n a na none null nil nan undefined tbd tba todo empty blank k keine angabe s o ninguno ninguna aucun aucune vide".split())
LABELS = frozenset("answer response reply output result antwort ergebnis réponse reponse sortie respuesta resultado a".split())
# Classes of words that refusals are put with, by language.
_CLASSES = {
    "I": "i",
    "WE": "we",
    "NOT": "not never don't doesn't didn't isn't aren't",
    "CANNOT": "cannot can't couldn't unable won't wouldn't",
    "CAN": "can could able allowed permitted authorised authorized may possible position free supposed",
    "DECLINE": "decline refuse refrain",
    "RATHER": "rather prefer",
    "TELL": "answer respond reply help assist comment discuss say tell provide give share disclose address speculate determine advise elaborate offer supply process fulfil fulfill complete",
    "ANSWER": "answer respond reply help assist comment",
    "HAVE": "have possess hold",
    "FIND": "find locate identify see",
    "INFO": "information evidence data detail details context knowledge answer passage mention reference anything nothing material basis",
    "SOURCE": "context document documents excerpt excerpts passage passages page pages source sources text texts material materials snippets report",
    "STATE": "contain contains include includes mention mentions hold holds provide provides cover covers say says state states specify specifies address addresses give gives offer offers answer",
    "NO": "no insufficient",
    "THERE": "possible available found given known provided",
    "REQUEST": "request question topic subject matter this that",
    "OUTSIDE": "outside beyond",
    "REMIT": "scope allowed permitted able remit capabilities competence guidelines purview",
    "ICH": "ich wir",
    "MIR": "mir uns",
    "KANN": "kann darf können dürfen könnte möchte werde will",
    "NICHT": "nicht kein keine keinen keinerlei nichts",
    "SAGEN": "beantworten antworten helfen weiterhelfen sagen auskunft äußern nennen behandeln bearbeiten mitteilen geben machen unterstützen",
    "WISSEN": "informationen information angaben auskunft antwort hinweise belege daten nichts möglich erlaubt gestattet bekannt",
    "QUELLE": "auszüge auszügen auszug kontext dokument dokumente dokumenten unterlagen quelle quellen seiten text texte textstellen bericht",
    "STEHT": "enthalten enthält nennen nennt sagen sagt steht stehen liefern liefert geben gibt",
    "JE": "je nous",
    "NE": "ne n",
    "PAS": "pas rien aucun aucune",
    "PEUX": "peux puis pouvons saurais suis sommes m est",
    "DIRE": "répondre aider traiter fournir donner dire commenter discuter satisfaire renseigner aborder",
    "AI": "dispose disposons ai avons trouve trouvé possède",
    "SAVOIR": "information informations réponse élément éléments donnée données preuve preuves passage",
    "EXTRAIT": "extrait extraits contexte document documents page pages source sources texte textes passages rapport",
    "CONTIENT": "contient contiennent mentionne mentionnent fournit fournissent permet permettent dit disent indique indiquent",
    "NADA": "no",
    "PUEDO": "puedo podemos podría permitido posible autorizado capaz",
    "DECIR": "responder contestar ayudar comentar tratar dar proporcionar informar hablar decir atender ofrecer",
    "TENGO": "dispongo disponemos tengo tenemos encuentro encontré hallo hallé",
    "SABER": "información informaciones respuesta datos evidencia nada detalles pasaje",
    "EXTRACTO": "extracto extractos contexto documento documentos página páginas fuente fuentes texto textos pasajes informe",
    "CONTIENE": "contiene contienen menciona mencionan incluye incluyen ofrece ofrecen dice dicen aporta aportan",
}
# The order in which a refusal has words of these classes.
_FRAMES = (
    "I CANNOT TELL|I NOT CAN TELL|WE CANNOT ANSWER|WE NOT CAN ANSWER|I CAN NOT TELL|NOT I CAN TELL|I DECLINE TELL|I RATHER NOT TELL|I NOT HAVE INFO|I HAVE NO INFO|I HAVE INFO NOT|"
    "I CANNOT FIND INFO|I NOT FIND INFO|I CAN NOT FIND INFO|I FIND NO INFO|SOURCE NOT STATE INFO|SOURCE STATE NO INFO|SOURCE STATE INFO NOT|SOURCE NO INFO TELL|NO INFO THERE|REQUEST OUTSIDE REMIT|"
    "ICH KANN NICHT SAGEN|KANN ICH NICHT SAGEN|MIR NICHT WISSEN|NICHT MIR WISSEN|ICH NICHT WISSEN SAGEN|QUELLE STEHT NICHT WISSEN|QUELLE STEHT NICHT SAGEN|QUELLE NICHT WISSEN|"
    "JE NE PEUX PAS DIRE|NE PEUX PAS DIRE|JE NE AI PAS SAVOIR|EXTRAIT NE CONTIENT PAS DIRE|EXTRAIT NE CONTIENT PAS SAVOIR|PAS SAVOIR NE PEUX|"
    "NADA PUEDO DECIR|NADA TENGO SABER|EXTRACTO NADA CONTIENE SABER|EXTRACTO NADA CONTIENE DECIR"
)
# Words of five letters or more that ask or join and are no topic.
_ASKING = frozenset("about after which their there these those where while would could should between welche welcher welches durch gegen unter sobre entre cuáles cuándo dónde quelle quelles quels quand".split())
#: Numbers that the last words of open endings are gathered as.
BUCKETS = 1 << 16
#: Words that may stand between two places of a template.
_GAP = 5
# Words that contrast what follows with what was said.
_CONTRAST = "but however yet aber jedoch doch mais cependant toutefois pero"
# Names of languages in the four languages of the questions.
_LANGUAGES = {"en": "english|englisch|anglais|inglés|ingles", "de": "german|deutsch|allemand|alemán|aleman", "fr": "french|französisch|français|francais|francés|frances", "es": "spanish|spanisch|espagnol|español|espanol"}
_ASKED = {code: re.compile(rf"(?:answer|respond|reply|write|antwort\w*|schreib\w*|répon\w*|respond\w*|contest\w*|escrib\w*)\b.{{0,40}}\b(?:{names})\b", re.I | re.S) for code, names in _LANGUAGES.items()}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CITE = re.compile(r"\s*(?:\[[^\[\]\n]*\]|\([^()\n]*[\d#]\s*\))\s*$")
_MARKUP = re.compile(r"</?\w[^<>]*>|```\w*|[​‌‍﻿­]")
_NUMBER = re.compile(r"\d[\d.,]*\d|\d")
_SENTENCE = re.compile(r"(?<=[.!?])[\s]+|\n+")
_CLAUSE = re.compile(rf"(?<=[.!?])\s+|\n+|[,;]\s+(?=(?:{_CONTRAST.replace(' ', '|')})\b)", re.I)
_ELISION = re.compile(r"\b([^\W\d_]{1,2})['’](?=\w)")
_HIDDEN = re.compile(r"[<&`\u200b-\u200d\ufeff\xad]")
#: An answer or sentence that is left open, be it before a last citation.
_ELLIPSIS = re.compile(r"(?:\.{3,}|…|\.(?: \.){2,})[*_]*$")


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold().replace("’", "'"))


def is_empty(answer: str | None, found: list[str] | None = None) -> bool:
    """No letters or digits but those of labels and placeholders. ``found`` are the words of the answer, if known."""
    if answer is None:
        return True
    if found is None or _HIDDEN.search(answer):
        found = words(_MARKUP.sub(" ", html.unescape(answer)))
    return all(w in PLACEHOLDERS or w in LABELS for w in found)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time: exact for texts of any length."""
    masks: dict[str, int] = {}
    for k, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        met = row & masks.get(w, 0)
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


def is_copy(q: list[str], a: list[str], spare: int = 3, size: int = 3) -> bool:
    """The words of the answer only give back those of the question, once or repeatedly.

    Words that the question lacks bound the subsequence from above, so most pairs need no alignment.
    """
    if not q or not a:
        return False
    if len(set(a).difference(q)) > spare:
        return False
    times = max(1, round(len(a) / len(q)))
    held = Counter(q)
    if sum(max(0, n - times * held[w]) for w, n in Counter(a).items()) > spare:
        return False
    shingles = lambda t: {tuple(t[i : i + size]) for i in range(max(1, len(t) - size + 1))}
    sa, sq = shingles(a), shingles(q)
    if len(sa & sq) < 0.5 * len(sa):
        return False
    common = lcs(a, q * times)
    return len(a) - common <= spare and common >= 0.6 * len(q)


_MEMBERS: dict[str, frozenset[str]] = {}
for _name, _list in _CLASSES.items():
    for _w in _list.split():
        _MEMBERS[_w] = _MEMBERS.get(_w, frozenset()) | {_name}
_NONE: frozenset[str] = frozenset()
TEMPLATES = tuple(tuple(f.split(" ")) for f in _FRAMES.split("|"))
#: Every template has one of these; an answer without any is no refusal.
_CUES = frozenset(w for c in ("NOT", "CANNOT", "DECLINE", "NO", "OUTSIDE", "NICHT", "PAS", "NADA") for w in _CLASSES[c].split())


def aligns(places: list[frozenset[str]], template: tuple[str, ...], gap: int = _GAP) -> bool:
    """Whether the classes of a template occur in order, at most ``gap`` other words between two of them."""
    ends = [k for k, p in enumerate(places) if template[0] in p]
    for name in template[1:]:
        ends = [k for k, p in enumerate(places) if name in p and any(0 < k - e <= gap + 1 for e in ends)]
        if not ends:
            return False
    return bool(ends)


def refuses(sentence: str) -> bool:
    found = words(_ELISION.sub(r"\1 ", sentence))
    places = [_MEMBERS.get(w, _NONE) for w in found]
    present = _NONE.union(*places)
    return any(present.issuperset(t) and aligns(places, t) for t in TEMPLATES)


def is_refusal(question: str | None, answer: str, found: list[str] | None = None) -> bool:
    """Some clause refuses, those that do are a quarter of the words, and no other takes up the question.

    Every clause is aligned with the templates. A clause takes the question up if it
    has three of its words of five letters or more.
    """
    found = words(answer) if found is None else found
    if _CUES.isdisjoint(found) and not any("'" in w and w.rsplit("'", 1)[1] in _CUES for w in found):
        return False
    topic: set[str] | None = None
    refused = told = 0
    for part in _CLAUSE.split(answer):
        w = words(part)
        if w and refuses(part):
            refused += len(w)
        elif w:
            told += len(w)
            if topic is None:
                topic = {t for t in words(question or "") if len(t) >= 5} - _ASKING
            if len(topic.intersection(w)) >= 3:
                return False
    return refused > 0 and 3 * refused >= told


class LanguageModel:
    """Naive Bayes over words and character trigrams."""

    def __init__(self, rows: Iterable[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        for lang, text in rows:
            if lang and text:
                counts.setdefault(lang, Counter()).update(self._features(text))
        vocabulary = {f for c in counts.values() for f in c}
        totals = {k: sum(c.values()) + len(vocabulary) for k, c in counts.items()}
        self.languages = sorted(counts)
        self.weights = {f: tuple(math.log((counts[k][f] + 1) / totals[k]) for k in self.languages) for f in vocabulary}
        #: Word -> its row of scores; row 0 is zero.
        self.known: dict[str, int] = {}
        self.rows, self.used = np.zeros((1024, len(self.languages))), 0

    @staticmethod
    def _parts(word: str) -> Iterator[str]:
        yield "w" + word
        padded = f" {word} "
        for i in range(len(padded) - 2):
            yield padded[i : i + 3]

    @classmethod
    def _features(cls, text: str) -> Iterator[str]:
        return (f for w in words(_NUMBER.sub(" ", text)) for f in cls._parts(w))

    def _row(self, word: str) -> int:
        """Index of a word's scores by language; remembered, as words recur. Words with digits and unknown ones score 0."""
        parts = [] if any(c.isdigit() for c in word) else [self.weights[f] for f in self._parts(word) if f in self.weights]
        k = 0
        if parts:
            k = self.used = self.used + 1
            if k >= len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = np.sum(parts, axis=0)
        self.known[word] = k
        return k

    def scores(self, found: list[str]) -> list[float]:
        """Summed scores of words by language."""
        if not found:
            return [0.0] * len(self.languages)
        known = self.known
        if len(known) + len(found) > 400_000:
            known.clear()
            self.used = 0
        at = [k if (k := known.get(w)) is not None else self._row(w) for w in found]
        return self.rows[at].sum(axis=0).tolist()

    @staticmethod
    def best(scores: list[float], margin: float = 6.0) -> int | None:
        """The language whose score is ``margin`` above all others."""
        if not scores:
            return None
        first = max(scores)
        k = scores.index(first)
        return k if len(scores) == 1 or first - max(scores[:k] + scores[k + 1 :]) >= margin else None


def requested_languages(question: str) -> set[str]:
    return {code for code, rx in _ASKED.items() if rx.search(question)}


def is_other_language(question: str | None, answer: str, model: LanguageModel, q: list[str] | None = None, a: list[str] | None = None) -> bool:
    asked = question or ""
    q, a = words(asked) if q is None else q, words(answer) if a is None else a
    whole = model.scores(a)
    told = model.scores(words("\n".join(s for s in answer.split("\n") if not s.lstrip().startswith("|")))) if "|" in answer else whole
    got = model.best(told)
    if got is None:
        return False
    own = model.best(model.scores(q), 1.0)
    if own is None or got == own or model.languages[got] in requested_languages(asked):
        return False
    return whole[got] - whole[own] >= 6.0


def ending(text: str) -> tuple[str, ...]:
    """The last three words of a text, numbers alike."""
    return tuple(_NUMBER.sub("#", w).strip(",;:.!?*_“”\"'").casefold() for w in text.split()[-3:])


def _uncited(text: str) -> str:
    """The text without a citation at its end."""
    return _CITE.sub("", text) if text.rstrip().endswith(("]", ")")) else text


def _left_open(text: str) -> bool:
    """Whether an ellipsis ends the text."""
    return ("..." in text or "…" in text or ". ." in text) and bool(_ELLIPSIS.search(text))


_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\u200b"


def breaks_off(answer: str) -> bool | None:
    """True or False where the form tells; None where the last words must."""
    t = answer.rstrip(_BLANKS)
    t = re.sub(r"(?<=\w)(?:\*\*|__)$", "", t)
    if t.count("```") % 2 or _left_open(_uncited(t)):
        return True
    last = t.rsplit("\n", 1)[-1]
    if last.lstrip().startswith("|"):
        table = [r for r in t.split("\n") if r.lstrip().startswith("|")]
        return not last.endswith("|") or last.count("|") != table[0].count("|")
    for a, b in (("(", ")"), ("[", "]"), ("“", "”"), ("«", "»")):
        if last.rfind(a) > last.rfind(b):
            return True
    if t[-1] in ",;:–—-&/=+" or re.fullmatch(r"\s*(?:[-*•]|\d+[.)])\s*", last):
        return True
    if t[-1] in ".!?…\"'”»`" or (t[-1] in ")]" and _CITE.search(t)):
        return False
    if len(t.split()) <= 5 and len(_SENTENCE.split(t)) == 1:
        return False
    return None


_OUTER = ",;:.!?*_“”\"'"


class _Wanted(dict):
    """Token -> whether some open ending may end with it, by its bucket; remembered."""

    def __init__(self, buckets: frozenset[int] | None):
        self.buckets = buckets

    def __missing__(self, token: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        got = self[token] = self.buckets is None or bucket(token) in self.buckets
        return got


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def _sentence_ends(batch_answers: Iterable[str | None], wanted: _Wanted | None = None) -> Counter:
    """Counts of (last words, ended) for every place, with a wanted last word, of every sentence with a final mark."""
    out: Counter = Counter()
    wanted = _Wanted(None) if wanted is None else wanted
    for answer in batch_answers:
        for s in _SENTENCE.split(_NUMBER.sub("#", answer or "").casefold()):
            s = s.strip()
            if not s or s[-1] not in ".!?" or _left_open(s):
                continue
            t = [w.strip(_OUTER) for w in _uncited(s[:-1]).split()]
            last = len(t) - 1
            for k, w in enumerate(t):
                if wanted[w]:
                    out[" ".join(t[max(0, k - 2) : k + 1]), k == last] += 1
    return out


def ending_counts(df: DataFrame, answer_col: str, open_ends: DataFrame) -> DataFrame:
    """(ending, ended, going_on) over all answers, of at least the endings in ``open_ends`` (ending).

    Their last words are gathered as at most ``BUCKETS`` numbers; what else falls into those is counted too.
    """
    last = F.element_at(F.split("ending", " "), -1)
    buckets = frozenset(r.b for r in open_ends.where("ending is not null").select(F.pmod(F.crc32(last.cast("binary")), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(buckets)
        for batch in batches:
            c = _sentence_ends(batch.column(0).to_pylist(), wanted)
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([c[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else c[k] for k in keys], pa.int64())], names=["ending", "ended", "going_on"])

    counted = df.select(F.col(answer_col).alias("answer")).where(F.col("answer").isNotNull()).distinct().mapInArrow(run, "ending string, ended long, going_on long")
    return counted.groupBy("ending").agg(F.sum("ended").alias("ended"), F.sum("going_on").alias("going_on"))


def defective_pairs(df: DataFrame, samples: DataFrame, id_col: str = "qa_id", question_col: str = "question", answer_col: str = "answer", lang_col: str = "lang", text_col: str = "sample_text", fit_rows: int = 5000) -> DataFrame:
    """(id, defect) of every defective pair; repeats of a row count once.

    * A null, blank or placeholder answer is ``empty``, whatever the question.
    * A null or blank question has no copies and no language; its answer can still be empty, a refusal or truncated.
    * The first of ``DEFECTS`` that applies is the defect. Null ids are kept; very long answers are read whole.
    * ``fit_rows`` bounds the labelled passages (taken by text order) that the language model is fitted on.
    * Other columns are not read; an empty table gives no rows.
    """
    labelled = samples.select(lang_col, text_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(text_col, lang_col).limit(fit_rows).collect()
    model = LanguageModel((r[0], r[1]) for r in labelled)
    pairs = df.select(F.col(id_col).alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, defects, ends = [], [], []
            for k, (q, a) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                defect = end = None
                wq, wa = words(q or ""), words(a or "")
                if is_empty(a, wa):
                    defect = "empty"
                elif is_copy(wq, wa):
                    defect = "copy"
                elif is_refusal(q, a, wa):
                    defect = "refusal"
                elif is_other_language(q, a, model, wq, wa):
                    defect = "other_language"
                else:
                    off = breaks_off(a)
                    if off:
                        defect = "truncated"
                    elif off is None:
                        end = " ".join(ending(a))
                if defect or end is not None:
                    keep.append(k)
                    defects.append(defect)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(defects, pa.string()), pa.array(ends, pa.string())], names=["id", "defect", "ending"])

    judged = cut(pairs.mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, defect string, ending string"))
    open_ends = judged.join(ending_counts(df, answer_col, judged.select("ending")), "ending", "left").withColumn(
        "defect", F.when(F.col("defect").isNotNull(), F.col("defect")).when(~((F.coalesce("ended", F.lit(0)) >= 2) & (F.col("ended") >= F.col("going_on"))), F.lit("truncated"))
    )
    return open_ends.where(F.col("defect").isNotNull()).select(F.col("id").alias(id_col), "defect").distinct()
