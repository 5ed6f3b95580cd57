"""Noise in text from scanned pages (problem 7).

Word counts of the whole corpus make the vocabulary. Words outside it are looked
up by a Levenshtein automaton whose edits are recognition errors (one or two
characters read as others, and a digit or sign inside a word read for any
letter), intersected with a trie of the vocabulary; so all words that an error
can have come from are found without trying each. Those that occur on the same
page rank first, then the more frequent. A line break with a mark inside a word
is told from one at a compound's own hyphen by the counts of both spellings.
Page furniture is what fills the outer blocks of a page and recurs on other
pages of its file, and printed page numbers.

Workers hold the ``HELD`` most frequent words. Counts of rarer ones, and rarer
words that a token may be a misreading of, come to the pages by joins: a token
and its source are alike once characters that errors exchange are made one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

KINDS = ("header", "hyphenation", "misread", "page_number")

# What is read -> what was printed.
CONFUSIONS = (
    "c e|e c|0 o|o 0|1 l|l 1|1 i|i 1|l i|i l|| l|| i|| 1|! l|! i|5 s|s 5|$ s|@ a|f t|t f|9 g|g 9|q 9|b h|h b|6 b|b 6|6 é|6 g|8 b|b 8|z 2|2 z|"
    "cl d|d cl|rn m|m rn|ri n|n ri|ii u|u ii|ii ü|vv w|w vv|h li|li h|ſ f|ſ s|€ e|n u|u n|íi ú|é e|á a|ó o|nn m"
)
RULES = tuple(tuple(r.split(" ")) for r in re.sub(r"\|\|", "\n¦", CONFUSIONS).replace("|", "\n").replace("¦", "|").split("\n") if r)
#: Words that every worker holds; the rest is joined.
HELD = 200_000
#: Occurrences of a word from which its count says something.
SUPPORT = 4
#: A word is a misread one only if the word it is read from occurs so many times as often.
RATIO, RATIO_SHORT = 8, 30
#: Pages of a file that a line must run on to be a header or footer.
HEADER_PAGES = 3

_BREAK = re.compile(r"(?<=[\w'’@|])([-­‐‑¬])[ \t]*\r?\n[ \t]*([^\W\d_][\w'’@|]*)")
_TOKEN = re.compile(r"[^\W_](?:[\w@|!$€]*[\w@|$€])?|[@$€][^\W_][\w@|]*")
_COMPOUND = re.compile(r"[^\W\d_][\w]*(?:[-‐‑][\w]+)+")
_MARKS = "-­‐‑¬"
_MARKED = re.compile(r"[-­‐‑¬][ \t]*\r?\n")
_NUMBER = re.compile(r"(?=.*\d)[\dol|i]{2,}")
_NUMBERS = re.compile(r"\d\|\d+\|\d")
_SIGNS = frozenset("0123456789@|$€!")
_BLANK = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
_LABEL = r"(?:\d{1,4}|[ivxlc]{1,7}|[a-z]-\d{1,3})"
_ALONE = re.compile(rf"(?:page|seite|página|pagina|pág\.|p\.|s\.)?\s*[-–—\[(|]*\s*({_LABEL})\s*(?:(?:/|of|von|de|sur)\s*[\dol]{{1,5}})?\s*[-–—\])|]*", re.I)
_TAIL = re.compile(rf"^(.*?\S)(?:\s*[|·•]\s*|\s+[–—-]\s+|\s{{2,}}|\t+)({_LABEL})$", re.I)
_HEAD = re.compile(rf"^({_LABEL})(?:\s*[|·•]\s*|\s+[–—-]\s+|\s{{2,}}|\t+)(\S.*)$", re.I)
_TAG = re.compile(r"</?(?:header|footer|page_number|page)>", re.I)
_ITEM = re.compile(r"\s*(?:[-*•]\s|\d+[.)]\s|\||#|>)")


def _words(chunk: str) -> Iterator[re.Match]:
    """Tokens of a stretch without whitespace; a list of numbers between bars has none."""
    if "|" in chunk and _NUMBERS.search(chunk):
        return iter(())
    return _TOKEN.finditer(chunk)


def count_chunks(text: str, into: Counter) -> None:
    """Stretches without whitespace; the two at a line break with a mark are parts and not counted."""
    if not _MARKED.search(text):
        into.update(text.split())
        return
    broken = False
    for line in text.split("\n"):
        chunks = line.split()
        if broken:
            chunks = chunks[1:]
        broken = bool(chunks) and chunks[-1][-1] in _MARKS
        into.update(chunks[:-1] if broken else chunks)


def count_words(chunks: Counter) -> Counter:
    """Words, compounds with their hyphens, and suspended first parts like ``haupt-``."""
    out: Counter = Counter()
    for chunk, n in chunks.items():
        low = chunk.lower()
        for m in _words(low):
            out[m.group()] += n
        if "-" in low or "‐" in low or "‑" in low:
            for m in _COMPOUND.finditer(low):
                out[m.group().replace("‐", "-").replace("‑", "-")] += n
            if low[-1] == "-" and len(low) > 2 and low[:-1].isalpha():
                out[low] += n
    return out


def allowed(token: str) -> int:
    """Errors that a token may have: two, or one in four characters."""
    return max(2, len(token) // 4)


def errors(token: str, word: str) -> int | None:
    """Fewest recognition errors that turn ``word`` into ``token``, None if none do; one sign inside may stand for any letter."""
    rows: dict[int, dict[tuple[int, bool], int]] = {0: {(0, False): 0}}
    n, m = len(token), len(word)
    for i in range(n):
        for (j, opened), used in rows.pop(i, {}).items():
            if j == m:
                continue
            steps = [(i + len(r), j + len(w), opened, 1) for r, w in RULES_BY_FIRST.get(token[i], ()) if token.startswith(r, i) and word.startswith(w, j)]
            if token[i] == word[j]:
                steps.append((i + 1, j + 1, opened, 0))
            elif not opened and 0 < i < n - 1 and token[i] in _SIGNS and word[j].isalpha():
                steps.append((i + 1, j + 1, True, 1))
            for x, y, o, cost in steps:
                row = rows.setdefault(x, {})
                if used + cost < row.get((y, o), 1 << 30):
                    row[y, o] = used + cost
    return min((u for (j, _), u in rows.get(n, {}).items() if j == m), default=None)


RULES_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _r, _w in RULES:
    RULES_BY_FIRST.setdefault(_r[0], []).append((_r, _w))


class Lexicon:
    """The most frequent words with their counts and trie, and the lookup of misread words.

    ``rare`` has what the held words can't tell of a page's tokens: a token's count and
    its sources among the other words as (errors, -count, word).
    """

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.trie: dict = {}
        for word, n in counts.items():
            if n >= RATIO and "-" not in word:
                node = self.trie
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = n
        self.known: dict[str, tuple[tuple[int, int, str], ...]] = {}
        self.sound: dict[str, bool] = {}
        self.rare: dict[str, tuple[int, tuple[tuple[int, int, str], ...]]] = {}

    def __reduce__(self):
        """Only the counts are sent to workers; they grow their own trie, however deep."""
        return Lexicon, (self.counts,)

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        return n if n is not None else self.rare[word][0] if word in self.rare else 0

    def is_sound(self, chunk: str) -> bool:
        """Whether a stretch without whitespace has no misread word; remembered.

        Where slashes or signs join its parts and one is no word at all, it is encoded data.
        """
        got = self.sound.get(chunk)
        if got is None:
            parts = [m.group() for m in _words(chunk)]
            got = not any(self.misread(t) for t in parts)
            if not got and re.search("[+/=]", chunk):
                got = any(not t.isdigit() and not self.count(t.lower()) and not self.misread(t) for t in parts)
            if not (self.rare and any(t.lower() in self.rare for t in parts)):
                if len(self.sound) > 300_000:
                    self.sound.clear()
                self.sound[chunk] = got
        return got

    def candidates(self, token: str) -> tuple[tuple[int, int, str], ...]:
        """(errors, -count, word) of the held words that ``token`` may be a misreading of."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[token] = self._candidates(token)
        return got

    def _candidates(self, token: str) -> tuple[tuple[int, int, str], ...]:
        found: dict[str, tuple[int, int]] = {}
        n, most = len(token), allowed(token)
        any_letter = any(c.isalpha() for c in token)
        stack = [(0, self.trie, "", 0, False)]
        while stack:
            i, node, word, used, opened = stack.pop()
            if i == n:
                if used and "" in node and (word not in found or found[word][0] > used):
                    found[word] = (used, -node[""])
                continue
            c = token[i]
            step = node.get(c)
            if step is not None:
                stack.append((i + 1, step, word + c, used, opened))
            if used < most:
                if any_letter and not opened and c in _SIGNS and 0 < i < n - 1:
                    for letter, at in node.items():
                        if letter and letter.isalpha():
                            stack.append((i + 1, at, word + letter, used + 1, True))
                for read, printed in RULES_BY_FIRST.get(c, ()):
                    if token.startswith(read, i):
                        at = node
                        for x in printed:
                            at = at.get(x)
                            if at is None:
                                break
                        else:
                            stack.append((i + len(read), at, word + printed, used + 1, opened))
        return tuple(sorted((u, m, w) for w, (u, m) in found.items()))

    def sources(self, token: str) -> tuple[str, ...]:
        """Words that ``token`` may be a misreading of, fewest errors first, then most frequent."""
        least = (RATIO if len(token) > 3 else RATIO_SHORT) * max(self.count(token), 1)
        digits = any(c.isdigit() for c in token)
        found = self.candidates(token)
        if token in self.rare:
            found = sorted({*found, *self.rare[token][1]})
        fits = [(u, w) for u, m, w in found if -m >= least]
        return tuple(w for u, w in fits if u == fits[0][0] and (digits or not w.isdigit()))

    def misread(self, token: str) -> tuple[str, ...] | None:
        """Candidates for a wrongly recognised token, best first; None if it is read well or unknown."""
        low = token.lower()
        if low.isdigit() or len(low) < 2:
            return None
        found = self.sources(low)
        if found:
            return found
        if _NUMBER.fullmatch(low) and not self.count(low):
            return (low.translate(str.maketrans("ol|i", "0111")),)
        return None

    def spellings(self, first: str, second: str) -> tuple[str, ...]:
        """Words whose counts tell how a word broken into two parts is written."""
        a, b = first.lower(), second.lower()
        tail = re.split(r"[-‐‑]", a)[-1]
        return tail + b, f"{a}-{b}", f"{tail}-{b}", f"{a}-", tail, b

    def hyphenated(self, first: str, mark: str, second: str) -> bool:
        """Whether a break between the two parts is inside a word written in one piece."""
        whole, *compounds, suspended, tail, b = self.spellings(first, second)
        joined, compound = self.count(whole), max(map(self.count, compounds))
        if joined or compound:
            return joined >= compound
        if self.count(suspended):
            return False
        if mark != "-":
            return True
        return second[0].islower() and (bool(self.sources(whole)) or min(self.count(tail), self.count(b)) < 2 * SUPPORT)

    def lacks(self, text: str) -> set[str]:
        """Tokens and spellings of a page that the held words don't have."""
        need = {t for chunk in set(text.split()) for m in _words(chunk) if len(t := m.group().lower()) > 1 and not t.isdigit() and t not in self.counts}
        for m in _BREAK.finditer(text):
            if first := left_part(text, m.start()):
                need.update(x for x in self.spellings(first, m.group(2)) if x not in self.counts)
        return need


def left_part(text: str, end: int) -> str:
    """The word that ends at ``end``, with its hyphens, however long."""
    at = end
    while at and (text[at - 1].isalnum() or text[at - 1] in "_'’@|-"):
        at -= 1
    while at < end and (not text[at].isalnum()):
        at += 1
    return text[at:end]


#: Each character as the smallest strokes that recognition takes apart or joins.
_STROKES = str.maketrans(
    {"1": "l", "i": "l", "|": "l", "!": "l", "í": "l", "ú": "ll", "u": "ll", "ü": "ll", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "n": "rl", "m": "rrl", "d": "el", "c": "e", "é": "e", "è": "e", "€": "e", "w": "vv", "0": "o", "ó": "o", "5": "s", "$": "s", "@": "a", "á": "a", "9": "g", "q": "g", "f": "t", "ſ": "t"}
)


def skeleton(line: str) -> str:
    """A header line as its recognition errors leave it alike."""
    return re.sub(r"\s+", " ", _TAG.sub(" ", line)).strip().lower().translate(_STROKES)


def _same_label(found: str, labels: list[str]) -> bool:
    plain = lambda x: x.lower().translate(str.maketrans("olsi|", "01511")).lstrip("0")
    return any(plain(found) == plain(x) for x in labels)


def line_key(skel: str) -> int:
    return int.from_bytes(hashlib.blake2b(skel.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Furniture:
    """Lines of the first two and last two blocks of a page that aren't running text."""

    def __init__(self, text: str, labels: list[str | None]):
        self.labels = [x.strip() for x in labels if x and x.strip() and x.strip() != "None"]
        self.lines = re.split(r"\r?\n", text)
        self.numbers: list[int] = []
        #: Line number -> (key of its skeleton, whether tagged as header or footer).
        self.headers: dict[int, tuple[int, bool]] = {}
        blocks: list[list[int]] = []
        for k, line in enumerate(self.lines):
            if line and not line.isspace():
                if blocks and k == blocks[-1][-1] + 1:
                    blocks[-1].append(k)
                else:
                    blocks.append([k])
        ends = blocks[:2] + [b for b in blocks[-2:] if b not in blocks[:2]] if len(blocks) > 1 else blocks
        for block in ends:
            self._block(block, block is blocks[0] or block is blocks[-1])

    def _block(self, block: list[int], outer: bool) -> None:
        tagged = any("<" in self.lines[k] and _TAG.search(self.lines[k]) for k in block)
        if not (outer or tagged):
            return
        if not tagged and any(self.lines[k].rstrip()[-1] in ".,;:" and not self._is_number(self.lines[k].strip()) for k in block):
            return
        numbers, headers = [], {}
        for k in block:
            line = self.lines[k].strip()
            bare = _TAG.sub(" ", line).strip()
            if not bare:
                continue
            if "page_number" in line.lower() or self._is_number(bare):
                numbers.append(k)
                continue
            if line.startswith(("#", "- ", "* ")):
                return
            tail, head = _TAIL.match(bare), _HEAD.match(bare)
            if tail and self._fits(tail.group(2)):
                numbers.append(k)
                bare = tail.group(1)
            elif head and self._fits(head.group(1)):
                numbers.append(k)
                bare = head.group(2)
            headers[k] = (line_key(skeleton(bare)), tagged)
        if not tagged:
            numbers = [k for k in numbers if k in (block[0], block[-1])]
        self.numbers += numbers
        self.headers |= headers

    def _is_number(self, bare: str) -> bool:
        m = _ALONE.fullmatch(bare) or _ALONE.fullmatch(re.sub(r"(?<=\d)[oOlI|]|[oOlI|](?=\d)", lambda m: "0" if m.group() in "oO" else "1", bare))
        return bool(m) and self._fits(m.group(1))

    def _fits(self, label: str) -> bool:
        return not self.labels or _same_label(label, self.labels) or not label.isdigit()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = count_words(c)
        return pa.RecordBatch.from_arrays([pa.array(list(words.keys()), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            count_chunks(text, c)
        if len(c) > 300_000:
            yield out()
            c.clear()
    yield out()


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of the words of all rows that occur at least ``SUPPORT`` times."""
    counted = df.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_counted, "word string, n long")
    return cut(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT))


def lexicon(counts: DataFrame, held: int = HELD) -> tuple[Lexicon, bool]:
    """The ``held`` most frequent words, and whether there are others."""
    sizes = {r.b: r.n for r in counts.groupBy(F.floor(4 * F.log2("n")).alias("b")).agg(F.count("*").alias("n")).collect()}
    floor, room = 1 << 40, held
    for b in sorted(sizes, reverse=True):
        room -= sizes[b]
        if room < 0:
            break
        floor = b
    rows = counts.where(F.floor(4 * F.log2("n")) >= floor).toArrow()
    return Lexicon(dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))), room < 0


#: One character for all that errors exchange with each other; their runs are one, as an error may join two of them.
_ALIKE = str.maketrans({c: to for to, cs in {"l": "1i|!lrnmuühb68ecdgq9íúéèè€", "s": "5$ſsft", "a": "@aá", "o": "0oó", "v": "vw", "z": "z2"}.items() for c in cs})


def alike(token: str) -> str:
    """A key that a word and its misreadings by ``RULES`` share."""
    return re.sub(r"(.)\1+", r"\1", token.translate(_ALIKE))


def keys_of(token: str, word: bool) -> set[str]:
    """Keys under which a token meets every word that it may be a misreading of: the common one and, with the place of each sign left open, those of its two sides."""
    inside = (i for i in range(1, len(token) - 1) if word or token[i] in _SIGNS)
    return {alike(token), *(f"{alike(token[:i])}*{alike(token[i + 1 :])}" for i in inside)}


def rare_words(src: DataFrame, counts: DataFrame, shared) -> DataFrame:
    """(key, rare) for each text that has tokens which the held words don't tell of: [(token, n, sources)].

    Tokens meet the words beyond those held by ``keys_of``; what meets is verified by ``errors``.
    """

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Lexicon = shared.value
        for batch in batches:
            keys, tokens = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                need = words.lacks(text)
                keys += [key] * len(need)
                tokens += need
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.string())], names=["key", "token"])

    def keyed(word: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [keys_of(t, word) for t in batch.column(0).to_pylist()]
                rows = batch.take(pa.array([k for k, keys in enumerate(each) for _ in keys], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for keys in each for x in keys], pa.string())], names=[*rows.schema.names, "alike"])

        return run

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = []
            for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                e = errors(t, w)
                used.append(e if e and e <= allowed(t) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(used, pa.int32())], names=[*batch.schema.names, "used"])

    need = src.select("key", "text").dropDuplicates(["key"]).mapInArrow(lacking, "key long, token string")
    each = need.select("token").distinct().join(counts.select(F.col("word").alias("token"), F.col("n").alias("own")), "token", "left").select("token", F.coalesce("own", F.lit(0)).alias("own"))
    others = counts.where(F.col("n") >= RATIO).where(~F.col("word").contains("-")).mapInArrow(_unheld(shared), "word string, n long")
    tokens = each.mapInArrow(keyed(False), "token string, own long, alike string")
    words = others.mapInArrow(keyed(True), "word string, n long, alike string")
    met = tokens.join(words, "alike").where((F.col("n") >= RATIO * F.greatest("own", F.lit(1))) & (F.col("token") != F.col("word"))).select("token", "word", "n").distinct()
    found = met.mapInArrow(explained, "token string, word string, n long, used int").where("used is not null")
    sources = found.groupBy("token").agg(F.collect_list(F.struct("used", (-F.col("n")).alias("m"), "word")).alias("sources"))
    told = each.join(sources, "token", "left").where("own > 0 or sources is not null")
    return need.join(told, "token").groupBy("key").agg(F.collect_list(F.struct("token", "own", "sources")).alias("rare"))


def _unheld(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.counts
        for batch in batches:
            yield batch.filter(pa.array([w not in held for w in batch.column(0).to_pylist()], pa.bool_()))

    return run


def _header_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, files, lines = [], [], []
        for i, f, text, label, page in zip(*(c.to_pylist() for c in batch.columns)):
            for key in {key for key, _ in Furniture(text, [label, page]).headers.values()}:
                ids.append(i)
                files.append(f)
                lines.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(files, pa.string()), pa.array(lines, pa.int64())], names=["id", "file", "line"])


def join_breaks(text: str, words: Lexicon) -> tuple[str, bool]:
    """The text with words and compounds whole again, and whether a word was broken."""
    out, at, broken = "", 0, False
    for m in _BREAK.finditer(text):
        out += text[at : m.start()]
        at = m.end()
        mark, second = m.groups()
        first = left_part(out, len(out))
        if not first:
            out += m.group()
            continue
        if words.hyphenated(first, mark, second):
            broken = True
            out += second
        else:
            low = first.lower()
            spaced = words.count(f"{low}-") and not words.count(f"{low}-{second.lower()}")
            out += ("- " if spaced else "-") + second
    return out + text[at:], broken


def repair_page(text: str, labels: list[str | None], headers: set[int], words: Lexicon) -> tuple[str, set[str]]:
    """The text as continuous paragraphs, and the kinds of noise that were in it."""
    kinds: set[str] = set()
    page = Furniture(text, labels)
    drop = set(page.numbers)
    if page.numbers:
        kinds.add("page_number")
    for k, (key, _) in page.headers.items():
        if key in headers:
            kinds.add("header")
            drop.add(k)
    on_page: set[str] = set()

    def mend(m: re.Match) -> str:
        token = m.group()
        found = words.misread(token)
        if not found:
            return token
        if not on_page:
            on_page.update(m.group() for m in _TOKEN.finditer(text.lower()))
        best = next((w for w in found if w in on_page), found[0])
        return best.upper() if token.isupper() and len(token) > 1 else best.capitalize() if token[:1].isupper() else best

    def mended(block: str) -> str:
        sound = words.sound
        bad = [c for c in set(block.split()) if not (sound[c] if c in sound else words.is_sound(c))]
        if not bad:
            return block
        kinds.add("misread")
        return re.sub(rf"(?<!\S)(?:{'|'.join(map(re.escape, bad))})(?!\S)", lambda c: _TOKEN.sub(mend, c.group()), block)

    for k in drop:
        mended(_TAG.sub(" ", page.lines[k]))
    body = "\n".join("" if k in drop or ("<" in line and not _TAG.sub("", line).strip()) else line for k, line in enumerate(page.lines))
    if _MARKED.search(body):
        body, broken = join_breaks(body, words)
        if broken:
            kinds.add("hyphenation")
    body = mended(body)
    out = []
    for block in _BLANK.split(body):
        lines: list[str] = []
        for line in block.split("\n"):
            line = line.strip()
            if not line:
                continue
            if lines and not _ITEM.match(line) and lines[-1][0] not in "#|":
                lines[-1] += " " + line
            else:
                lines.append(line)
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out), kinds


def repair_pages(df: DataFrame, id_col: str = "id", file_col: str = "source_file", text_col: str = "text", label_col: str = "page_number_raw", page_col: str = "page_number", held: int = HELD) -> DataFrame:
    """(id, text, noise): every row with a text, repaired, and its kinds of noise, sorted.

    * Null texts give no row; empty and blank ones an empty text without noise. Null
      ids are kept; repeated rows give repeated rows. Whole texts are read.
    * ``label_col`` may be null, empty or wrong, ``page_col`` null: a printed number
      must equal one of them only where one is known.
    * A null file is a file of its own. A line must run on ``HEADER_PAGES`` ids of its file.
    * ``held`` bounds the words in memory; the result is the same with any.
    * Columns other than the five are not read; an empty table gives no rows.
    """
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(file_col).alias("file"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.col(page_col).cast("string").alias("page")).where("text is not null")
    counts = word_counts(src, "text")
    words, more = lexicon(counts, held)
    shared = df.sparkSession.sparkContext.broadcast(words)
    lines = cut(src.mapInArrow(_header_lines, "id string, file string, line long").distinct())
    running = lines.groupBy("file", "line").agg(F.count_distinct(F.coalesce("id", F.lit(""))).alias("n")).where(F.col("n") >= HEADER_PAGES)
    a, b = lines.alias("a"), running.alias("b")
    headed = a.join(b, F.col("a.file").eqNullSafe(F.col("b.file")) & (F.col("a.line") == F.col("b.line"))).groupBy("a.id").agg(F.collect_set("a.line").alias("headers"))
    rows = src.withColumn("rare", F.lit(None).cast("array<struct<token: string, own: bigint, sources: array<struct<used: int, m: bigint, word: string>>>>"))
    if more:
        keyed = src.withColumn("key", F.xxhash64("text"))
        rows = keyed.join(rare_words(keyed, counts, shared), "key", "left").drop("key")
    rows = rows.alias("s").join(headed.alias("h"), F.col("s.id").eqNullSafe(F.col("h.id")), "left").select("s.id", "text", "label", "page", "headers", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Lexicon = shared.value
        for batch in batches:
            texts, noise = [], []
            for _, text, label, page, headers, rare in zip(*(c.to_pylist() for c in batch.columns)):
                words.rare = {r["token"]: (r["own"], tuple((s["used"], s["m"], s["word"]) for s in r["sources"] or ())) for r in rare or ()}
                repaired, kinds = repair_page(text, [label, page], set(headers or ()), words)
                texts.append(repaired)
                noise.append(sorted(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(noise, pa.list_(pa.string()))], names=["id", "text", "noise"])

    return rows.mapInArrow(run, "id string, text string, noise array<string>")
