"""Variant spellings of names typed by people (problem 2).

Names are folded and split into tokens. Tokens that names of several companies
share (given names, lines of business) are common; the others are rare and carry
a name's identity. Names meet by a prefix-filtered set-similarity join on the
q-grams of every rare token: in an order that puts rare letters first, a few
grams suffice. Of those that meet, names whose other tokens can align at all
are verified by a soft token similarity with weights by rarity: equal words,
typos, nicknames, abbreviations, initials or acronyms. Verified links are
closed into groups.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import company_key, name_key
from lodestrata.operators.graph import connected_components
from lodestrata.session import cut

# Legal forms, titles, words without weight, words that name sites.
LEGAL = frozenset("ag aktiengesellschaft anonyme bv co company corp corporation gesellschaft gmbh haftung inc incorporated kg limited llc ltd mbh nv oy plc sa sarl se societe spa srl".split())
TITLES = frozenset("dr frau herr ing jr lady lord md mr mrs ms phd prof professor sir sr".split())
IDLE = frozenset("and beschrankter de der die et mit of the und".split())
#: Idle between two words of an organisation, else an initial.
JOINING = "y"
SITES = frozenset("building campus center centre depot facility factory farm hub mill mine office plant port site station warehouse".split())
# Given names and their short forms.
NICKNAMES = {
    line.split(":")[0]: line.split(":")[1].split()
    for line in """abraham:abe bram
agnes:aggie
albert:al bert bertie
alejandro:ale jandro
alexander:alex sandy sasha xander
alexandra:alexa lexi sandra
alfred:alf fred alfie
amanda:mandy
andrew:andy drew
angela:angie
anna:annie nan
annabella:bella
anthony:tony ant
antonio:toni nio
arthur:art artie
barbara:barb babs barbie
beatrice:bea trixie
benjamin:ben benny benji
bernard:bernie
bernhard:bernd
brigitte:gitte
calvin:cal
caroline:carrie caro lina
catherine:cathy cat kate
charles:charlie chuck chas
charlotte:lottie charly
christina:tina chrissie
christoph:chris stoffel
christopher:chris kit topher
concepcion:concha conchita
constance:connie
cynthia:cindy
daniel:dan danny
david:dave davey
deborah:deb debbie
dolores:lola
dominic:dom nick
donald:don donny
dorothea:dora thea
dorothy:dot dottie
douglas:doug
eduard:edi ede
eduardo:lalo edu
edward:ed eddie ned ted
eleanor:ellie nell nora
elisabeth:elsa lisbeth liesel
elizabeth:beth betty eliza lisa liz lizzie libby
enrique:quique kike
ernst:erni
eugene:gene
eva:evi
ferdinand:ferdi
florence:flo
frances:fran fanny
francis:frank
francisco:paco pancho curro
franziska:franzi
frederick:fred freddie rick
friedrich:fritz fred friedel
gabriel:gabe
gabriela:gabi
georg:schorsch
gerald:gerry
gertrude:trudy gert
gregory:greg
guadalupe:lupe lupita
guillermo:memo guille
gustav:gustl
hannelore:hanne lore
harold:harry hal
heinrich:heinz heiner
helena:lena
henrietta:etta hettie
henrik:rik
henry:harry hank
herbert:herb
ignacio:nacho
isabella:bella izzy
jacob:jake
jacqueline:jackie
jakob:jockel
james:jim jimmy jamie
janet:jan
jeffrey:jeff
jennifer:jen jenny
jessica:jess jessie
jesus:chucho chuy
joachim:jochen achim
johannes:hannes hans
john:jack johnny
jonathan:jon
jose:pepe chepe
josef:sepp
josefa:pepa fefa
joseph:joe joey
joshua:josh
judith:judy
katharina:kathi kati
katherine:kate kathy katie kitty
kenneth:ken kenny
konstantin:kosta
lawrence:larry
leonard:leo len lenny
leopold:poldi
lillian:lily lil
louis:lou
ludwig:wiggerl
luis:lucho
magdalena:lena magda leni
manuel:manolo manny
marcus:marc
margaret:maggie meg peggy greta madge
margarete:grete gretel
maria:mia mitzi
martha:marty patty
martin:marty
mathilde:tilda
matthew:matt
maximilian:max
mercedes:merche
michael:mick mike mickey
mohammed:mo
nathaniel:nat nate
nicholas:nick nicky
nicole:nicky
nikolaus:klaus niko nick
oliver:ollie
pamela:pam
patricia:pat patty tricia
patrick:pat paddy
peter:pete
philip:phil pip
rafael:rafa
raymond:ray
rebecca:becky becca
reginald:reg reggie
richard:dick rick richie rich
robert:bob bobby rob robbie bert
roberto:beto
rodrigo:rodri
rosalind:roz
rosario:charo
rosemary:rose romy
salvador:chava
samuel:sam sammy
sebastian:basti seb
sergio:checo
siegfried:sigi
sophia:sophie
stanley:stan
stephen:steve
susanna:susi sanna
susannah:sue susie
teresa:tere
theodore:ted teddy theo
theresa:tess terry resi
thomas:tom tommy
timothy:tim
ulrich:uli ulli
ursula:uschi ursel
valentina:tina val
veronica:ronnie
victor:vic
victoria:tori vicky
vincent:vince
virginia:ginny
walter:walt wally
wilhelm:willi helmi
wilhelmina:minna mina
william:bill billy liam will willy
yolanda:yoli
zofia:zosia""".split("\n")
}

#: A token is common if names of this many companies have it.
COMMON_COMPANIES = 3
#: Common tokens that every worker holds; the rest is joined.
HELD = 100_000
#: Rare tokens that a name is met by.
KEYS = 4
#: A common token names a line of business if at least this share of its names has a legal form.
ORG_SHARE = 0.15
#: Smallest soft similarity of two names.
LEAST = 0.6


_SPELLED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "oe", "å": "aa"})


def fold_tokens(name: str) -> list[str]:
    """Lower-case tokens, umlauts spelled out, other marks dropped; hyphens join, dotted letters join or part by what they spell."""
    return [t for t, _ in _folded(name)]


def _folded(name: str) -> list[tuple[str, bool]]:
    """Tokens, and whether each is ``JOINING`` written as a word: without a dot and not after a comma."""
    s = html.unescape(html.unescape(name)).lower().translate(_SPELLED)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = re.sub(r"(?<=\w)[-‐‑'’](?=\w)", "", s)
    out: list[tuple[str, bool]] = []
    for m in re.finditer(r"[^\s,;:&/()\"]+", s):
        raw = m.group()
        bare = re.sub(r"[\W_]+", "", raw)
        if not bare:
            continue
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?", raw) and len(bare) > 1 and bare not in LEGAL | TITLES:
            out += [(c, False) for c in bare]
        else:
            out.append((bare, raw == JOINING and not s[: m.start()].rstrip().endswith(",")))
    return out


#: Short form -> the given names that it may stand for.
_SHORT: dict[str, list[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _s in _shorts:
        _SHORT.setdefault(_s, []).append(_full)


def near(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def shortens(a: str, b: str) -> bool:
    """Whether ``a`` may abbreviate ``b``: same first letter, its letters in order, shorter."""
    if not 2 <= len(a) < len(b) or a[0] != b[0]:
        return False
    stem = a.rstrip("s") if len(a) > 3 else a
    it = iter(b)
    return b.startswith(stem) or (len(a) >= 3 and all(c in it for c in a))


class Vocabulary:
    """Common tokens with their counts; maps typed tokens to them."""

    def __init__(self, counts: dict[str, int], org_share: dict[str, float], total: int, nicknames: bool = True):
        self.counts, self.org_share, self.total = counts, org_share, max(2, total)
        self.short = _SHORT if nicknames else {}
        self.longest = max(map(len, counts), default=0)
        #: Common tokens of the name at hand that aren't held: token -> (count, share of legal forms).
        self.more: dict[str, tuple[int, float]] = {}
        self.known: dict[str, str | None] = {}
        self.by_delete: dict[str, list[str]] = {}
        for word in counts:
            for d in self._deletes(word):
                self.by_delete.setdefault(d, []).append(word)
        self.first: dict[str, list[str]] = {}
        for word in counts:
            self.first.setdefault(word[0], []).append(word)

    @staticmethod
    def _deletes(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

    def is_common(self, token: str) -> bool:
        return token in self.counts or token in self.more

    def is_line(self, token: str | None) -> bool:
        """Whether a token names a line of business."""
        share = self.org_share.get(token, 0.0) if token in self.counts else self.more.get(token, (0, 0.0))[1]
        return share >= ORG_SHARE

    def canonical(self, token: str) -> str | None:
        """The common word that ``token`` stands for, or None."""
        if token in self.more:
            return token
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self._canonical(token)
        return self.known[token]

    def _canonical(self, token: str) -> str | None:
        own = self.counts.get(token, 0)
        fulls = self.short.get(token)
        if fulls:
            return max(fulls, key=lambda w: (self.counts.get(w, 0), w))
        if 4 <= len(token) <= self.longest + 1 and not token.isdigit():
            close = {w for d in self._deletes(token) for w in self.by_delete.get(d, ()) if w != token and len(w) >= 4 and self.counts[w] >= (10 * own or 5) and near(token, w)}
            if close:
                return max(close, key=lambda w: (self.counts[w], w))
        if len(token) >= 3 and token.isalpha():
            full = [w for w in self.first.get(token[0], ()) if self.org_share[w] >= ORG_SHARE and self.counts[w] >= 10 * max(1, own) and shortens(token, w)]
            for some in ([w for w in full if w.startswith(token.rstrip("s"))], full):
                if len(some) == 1:
                    return some[0]
        return token if own else None

    def weight(self, token: str) -> float:
        n = self.counts.get(token) or self.more.get(token, (1, 0.0))[0]
        return math.log(1 + self.total / n)


def is_site(tokens: list[str], canonical: list[str | None], vocabulary: Vocabulary) -> bool:
    """A name that ends in a word for a place, but for its number, or begins with one and names no line of business."""
    named = [k for k, t in enumerate(tokens) if not t.isdigit()]
    if not named or not any(t in SITES for t in tokens):
        return False
    return tokens[named[-1]] in SITES or (tokens[named[0]] in SITES and not any(vocabulary.is_line(c) for c, t in zip(canonical, tokens) if t not in SITES))


def parse(name: str, vocabulary: Vocabulary) -> list[tuple[str, list[str], str]]:
    """(rare token, other tokens sorted, kind) of a name, for each of its ``KEYS`` longest rare tokens; none for a name without letters or digits.

    Names of one entity have all their rare tokens in common, but for how they are spelt,
    so a few are enough to meet by. A name without a rare token has its least common one
    instead. kind is ``org``, ``person`` or ``site``.
    """
    folded = _folded(name)
    legal = any(t in LEGAL for t, _ in folded)
    kept = [x for x in folded if x[0] not in LEGAL and x[0] not in TITLES and x[0] not in IDLE] or [x for x in folded if x[0] not in IDLE]
    if not kept:
        return []
    words = [(t, vocabulary.canonical(t)) for t, _ in kept]
    if legal or any(vocabulary.is_line(c) for _, c in words):
        words = [w for k, w in enumerate(words) if not (kept[k][1] and 0 < k < len(words) - 1 and len(words[k - 1][0]) > 1 and len(words[k + 1][0]) > 1)]
    rare = {t for t, c in words if c is None and len(t) > 1 and not t.isdigit()}
    keys = sorted(rare, key=lambda t: (-len(t), t))[:KEYS] or [max(words, key=lambda w: (len(w[0]) > 1, vocabulary.weight(w[1] or w[0]), w[0]))[0]]
    if is_site([t for t, _ in words], [c for _, c in words], vocabulary):
        kind = "site"
    elif legal or any(vocabulary.is_line(c or t) for t, c in words if t not in rare):
        kind = "org"
    else:
        kind = "person"
    out = []
    for key in keys:
        rest, dropped = [], False
        for t, c in words:
            if t == key and not dropped:
                dropped = True
            else:
                rest.append(c or t)
        out.append((key, sorted(rest), kind))
    return out


def near_keys(a: str, b: str) -> bool:
    """Rare tokens that may be one: in words under five letters a typo that exchanges one letter for another makes another word."""
    return near(a, b) and (min(len(a), len(b)) >= 5 or a == b or len(a) != len(b) or sorted(a) == sorted(b))


def compare(key_a: str, a: list[str], kind_a: str, key_b: str, b: list[str], kind_b: str, vocabulary: Vocabulary) -> tuple[float, str]:
    """(similarity, weak): 0 if the names can't be one entity; ``weak`` is a given name matched by an initial alone."""
    if "site" in (kind_a, kind_b) or not near_keys(key_a, key_b):
        return 0.0, ""
    if len(a) > len(b):
        a, b = b, a
    left, matched, weak = list((Counter(b) - Counter(a)).elements()), 0.0, ""
    same = [t for t in (Counter(a) & Counter(b)).elements()]
    matched = sum((1.0 if len(t) > 1 else 0.8) * vocabulary.weight(t) for t in same)
    firm = any(len(t) > 1 for t in same)
    for t in sorted((Counter(a) - Counter(b)).elements(), key=lambda t: -len(t)):
        best, how = None, 0.0
        for u in left:
            if t.isdigit() or u.isdigit():
                s = 0.0
            elif len(t) == 1 or len(u) == 1:
                s = 0.7 if t[0] == u[0] else 0.0
            elif len(t) >= 4 and len(u) >= 4 and near(t, u) and not (vocabulary.is_common(t) and vocabulary.is_common(u)):
                s = 0.9
            elif (not vocabulary.is_common(t) and shortens(t, u)) or (not vocabulary.is_common(u) and shortens(u, t)):
                s = 0.8
            else:
                s = 0.0
            if s > how:
                best, how = u, s
        if best is None:
            rest = [u[0] for u in left]
            if len(t) >= 2 and sorted(t) == sorted(rest) and len(rest) >= 2 and not vocabulary.is_common(t):
                matched += 0.8 * sum(vocabulary.weight(u) for u in left)
                left, firm = [], True
                continue
            return 0.0, ""
        left.remove(best)
        long = max(t, best, key=len)
        if how >= 0.75 and len(long) > 1:
            firm = True
        elif len(long) > 1:
            weak = long
        matched += how * vocabulary.weight(long)
    org = "org" in (kind_a, kind_b)
    if any(len(u) > 1 for u in left) or (org and left) or (not a and b):
        return 0.0, ""
    if org and not firm and a:
        firm, weak = True, ""
    weights = sum(vocabulary.weight(t) for t in b if len(t) > 1) or sum(vocabulary.weight(t) for t in a if len(t) > 1)
    rare = math.log(1 + vocabulary.total)
    alike = 1.0 if key_a == key_b else 0.9
    return (alike * rare + matched) / (rare + max(weights, matched)), "" if firm else weak


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _typos(token: str) -> list[str]:
    """What a token and any one edit or swap away from it have in common: it without each of its letters or, of a long one, its two ends."""
    if len(token) > 18:
        return [f"{token[:8]}<", f">{token[-8:]}"]
    return [f"{token}-", *(f"{token[:i]}{token[i + 1 :]}-" for i in range(len(token)))]


def forms_of(rest: list[str], vocabulary: Vocabulary) -> list[tuple[int, bool]]:
    """(form, own) under which the other tokens of a name can meet those of another that ``compare`` may accept.

    A form is a bag of tokens, as the sum of their numbers, with initials as ``w~``. Own
    forms are the tokens themselves, with some of the initials or none; those in which a
    token that isn't common stands as what its typos leave of it; and acronyms. Any token
    may also be met by its initial: two names meet if one has the form as its own.
    """
    full, initials = [t for t in rest if len(t) > 1], [f"{t}~" for t in rest if len(t) == 1]
    tails = {tuple(sorted(c)) for n in range(len(initials) + 1) for c in itertools.combinations(initials, n)} if len(initials) <= 4 else {(), tuple(sorted(initials))}
    if not full and initials:
        tails.discard(())
    tokens = {t: _number(t) for t in {*full, *initials}}
    whole = sum(tokens[t] for t in full)
    forms: dict[int, bool] = {}

    def add(form: int, own: bool) -> None:
        form = (form + (1 << 63)) % (1 << 64) - (1 << 63)
        forms[form] = own or forms.get(form, False)

    others = [(t, [_number(x) for x in ([] if vocabulary.is_common(t) else _typos(t))], _number(f"{t[0]}~"), not vocabulary.is_common(t)) for t in set(full)]
    for tail in tails:
        base = whole + sum(tokens[t] for t in tail)
        add(base, True)
        for t, typos, initial, own in others:
            for x in typos:
                add(base - tokens[t] + x, True)
            add(base - tokens[t] + initial, own)
    if len(rest) >= 2:
        add(_number("".join(sorted(t[0] for t in rest)) + "="), True)
        add(sum(_number(f"{t[0]}~") for t in rest), not full)
    elif len(full) == 1 and not vocabulary.is_common(full[0]):
        add(_number("".join(sorted(full[0])) + "="), True)
    return list(forms.items())


# Letters and digits, those that names seldom have first, and what they are ordered as.
_BY_RARITY = ("qxzjwyvkfgpbdchmutlsornieaQ0123456789", "abcdefghijklmnopqrstuvwxyz{0123456789")


def _grams(c):
    """3-grams of a padded token, those of seldom letters first; a short token also has what is left of it without each of its letters."""
    padded = F.concat(F.lit("#"), c, F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))
    first = F.slice(F.transform(F.array_sort(F.transform(grams, lambda g: F.struct(F.translate(g, *_BY_RARITY).alias("o"), g.alias("g")))), lambda x: x["g"]), 1, 5)
    without = F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), F.greatest(i - 1, F.lit(0))), F.when(i > 0, F.substring(c, i + 1, F.length(c))).otherwise(c), F.lit("-")))
    ends = F.array(F.concat(F.left(c, F.lit(8)), F.lit("<")), F.concat(F.lit(">"), F.right(c, F.lit(8))))
    return F.when(F.length(c) > 18, ends).when(F.length(c) < 7, F.array_distinct(without)).otherwise(F.array_distinct(F.concat(first, F.when(F.length(c) >= 18, ends).when(F.length(c) == 7, without).otherwise(F.array().cast("array<string>")))))


def similar_keys(keys: DataFrame) -> DataFrame:
    """(company, key_a, key_b), the smaller first, of rare tokens at most one edit or swap apart.

    One such edit touches at most four of a token's 3-grams, so of the first five
    grams of either token, in one order of all grams, at least one is shared: only
    those are joined. Tokens of six letters or less meet by what one deletion leaves,
    those of seven by both. Of tokens beyond eighteen letters one of the two ends is
    the same, those of eighteen meet by both. Tokens beyond 64 letters, for which the
    built-in distance takes long, are left to ``compare``.
    """
    prefix = keys.select("company", "key", F.explode(_grams(F.col("key"))).alias("gram")).select("company", "key", F.xxhash64("company", "gram").alias("gram"))
    a, b = prefix.withColumnRenamed("key", "key_a"), prefix.withColumnRenamed("key", "key_b")
    letters = lambda c: F.array_sort(F.split(c, ""))
    distance = F.levenshtein("key_a", "key_b", 2)
    met = a.join(b, (a["gram"] == b["gram"]) & (F.col("key_a") < F.col("key_b")) & (F.abs(F.length("key_a") - F.length("key_b")) <= 1) & (a["company"] == b["company"])).select(a["company"], "key_a", "key_b")
    close = distance.isin(0, 1) | ((distance == 2) & (letters("key_a") == letters("key_b")))
    return met.where(F.when(F.length("key_a") <= 64, close).otherwise(F.lit(True))).distinct()


def _form_tokens(forms: DataFrame) -> DataFrame:
    """(company, name, token, legal): the distinct tokens of each name, and whether it has a legal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, token, legal = [], [], []
            for k, name in enumerate(batch.column(1).to_pylist()):
                tokens = set(fold_tokens(name))
                at += [k] * len(tokens)
                token += tokens
                legal += [bool(tokens & LEGAL)] * len(tokens)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(token, pa.string()), pa.array(legal, pa.bool_())], names=["company", "name", "token", "legal"])

    return forms.select("company", "name").mapInArrow(run, "company string, name string, token string, legal boolean")


def _token_stats(forms: DataFrame) -> DataFrame:
    per_company = _form_tokens(forms).groupBy("token", "company").agg(F.count("*").alias("n"), F.count_if("legal").alias("n_legal"))
    return per_company.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_legal").alias("n_legal"), F.count("*").alias("companies"))


def entity_groups(df: DataFrame, id_col: str = "entity_id", company_col: str = "company", name_col: str = "entity_name", nicknames: bool = True, held: int = HELD) -> DataFrame:
    """(entity_id, company, group_id) of entities whose names are those of persons or organisations.

    * Rows with a null id, or a null name or one without letters or digits, are in no group.
    * Companies compare trimmed and lower-cased, null being one of its own; the
      type column is not read, nor is any other.
    * Names of sites are in no group. A group may have one id.
    * Common tokens are those of at least ``COMMON_COMPANIES`` companies, whatever the
      size of the table. ``held`` bounds those that workers hold, the most frequent: only
      they are read out of typos and abbreviations; others are known by a join.
    * ``nicknames`` turns the list of given names and their short forms on.
    """
    rows = df.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(company_key(company_col), F.lit("")).alias("company"), name_key(name_col).alias("name")
    ).where("id is not null and name is not null and name <> ''")
    members = cut(rows.distinct())
    forms = members.select("company", "name").distinct()
    total = forms.count()
    stats = cut(_token_stats(forms).where((F.col("companies") >= COMMON_COMPANIES) & (F.length("token") > 1) & ~F.col("token").isin(*(LEGAL | TITLES | IDLE))))
    sizes = {r.b: r.n for r in stats.groupBy(F.floor(4 * F.log2("n")).alias("b")).agg(F.count("*").alias("n")).collect()}
    floor, room = 1 << 40, held
    for b in sorted(sizes, reverse=True):
        room -= sizes[b]
        if room < 0:
            break
        floor = b
    kept = stats.where(F.floor(4 * F.log2("n")) >= floor).collect()
    vocabulary = Vocabulary({r.token: r.n for r in kept}, {r.token: r.n_legal / r.n for r in kept}, total, nicknames)
    known = forms.withColumn("more", F.lit(None).cast("array<struct<token: string, n: bigint, share: double>>"))
    if room < 0:
        others = stats.where(F.floor(4 * F.log2("n")) < floor).select("token", "n", (F.col("n_legal") / F.col("n")).alias("share"))
        each = _form_tokens(forms).join(others, "token").groupBy("company", "name").agg(F.collect_list(F.struct("token", "n", "share")).alias("more"))
        known = forms.join(each, ["company", "name"], "left")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for c, n, more in zip(*(x.to_pylist() for x in batch.columns)):
                vocabulary.more = {m["token"]: (m["n"], m["share"]) for m in more or ()}
                for key, rest, kind in parse(n, vocabulary):
                    if kind != "site":
                        met = forms_of(rest, vocabulary)
                        sig = int.from_bytes(hashlib.blake2b("\x01".join([c, kind, *sorted([key, *rest])]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                        got.append((c, n, sig, key, rest, kind, [f for f, own in met if own], [f for f, own in met if not own], more))
            cols = list(zip(*got)) or [()] * 9
            lists = pa.list_(pa.string())
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), lists, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), batch.schema.field(2).type]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["company", "name", "sig", "key", "rest", "kind", "own", "other", "more"])

    signed = cut(known.mapInArrow(parsed, "company string, name string, sig long, key string, rest array<string>, kind string, own array<bigint>, other array<bigint>, more array<struct<token: string, n: bigint, share: double>>"))
    sigs = signed.drop("name").distinct()
    keys = sigs.select("company", "key").distinct()
    alike = cut(similar_keys(keys))
    met = keys.select("company", "key", F.col("key").alias("head")).unionByName(alike.select("company", F.col("key_b").alias("key"), F.col("key_a").alias("head")))
    headed = cut(sigs.join(met, ["company", "key"]))
    cells = headed.select(F.xxhash64("company", "head").alias("at"), (F.col("key") == F.col("head")).alias("heads"), "sig", F.xxhash64("key").alias("key"), F.explode(F.concat(F.transform("own", lambda f: F.struct(f.alias("form"), F.lit(True).alias("mine"))), F.transform("other", lambda f: F.struct(f.alias("form"), F.lit(False).alias("mine"))))).alias("f"))
    side = lambda s: cells.select(F.xxhash64("at", "f.form").alias("form"), F.col("f.mine").alias(f"mine_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("heads", "sig", "key")])
    meeting = (
        side("a").where("mine_a")
        .join(side("b"), "form")
        .where("sig_a <> sig_b and (not mine_b or sig_a < sig_b) and (heads_a or heads_b)")
        .select("sig_a", "key_a", "sig_b", "key_b")
        .distinct()
    )
    details = sigs.select("sig", F.xxhash64("key").alias("hash"), "key", "rest", "kind", "more")
    told = lambda df, s: df.join(details.select(*[F.col(c).alias(f"{c}_{s}" if c != "hash" else f"key_{s}") for c in ("sig", "hash")], *[F.col(c).alias(f"{c if c != 'key' else 'token'}_{s}") for c in ("key", "rest", "kind", "more")]), [f"sig_{s}", f"key_{s}"])
    candidates = told(told(meeting, "a"), "b").select("sig_a", "token_a", "rest_a", "kind_a", "more_a", "sig_b", "token_b", "rest_b", "kind_b", "more_b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, weak, at = [], [], [], []
            for sa, ka, ra, da, ma, sb, kb, rb, db, mb in zip(*(c.to_pylist() for c in batch.columns)):
                vocabulary.more = {m["token"]: (m["n"], m["share"]) for m in (*(ma or ()), *(mb or ()))}
                score, w = compare(ka, ra, da, kb, rb, db, vocabulary)
                if score >= LEAST:
                    initials = sa if not any(len(t) > 1 for t in ra) else sb
                    a.append(sa)
                    b.append(sb)
                    weak.append(w or None)
                    at.append(initials if w else None)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(weak, pa.string()), pa.array(at, pa.int64())], names=["src", "dst", "given", "initials"])

    edges = cut(candidates.mapInArrow(verified, "src long, dst long, given string, initials long").distinct())
    unclear = edges.where("initials is not null").groupBy("initials").agg(F.count_distinct("given").alias("n")).where("n > 1").select("initials")
    links = edges.join(unclear, "initials", "left_anti").select("src", "dst")
    components = connected_components(links)
    named = signed.select("company", "name", "sig").distinct()
    grouped = named.join(components.withColumnRenamed("id", "sig"), "sig", "left").select("company", "name", F.coalesce("component", "sig").alias("group_id"))
    return members.join(grouped, ["company", "name"]).select(F.col("id").alias("entity_id"), "company", "group_id").distinct()


def entity_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of different ids of a group, the smaller first."""
    a, b = groups.select("company", "group_id", F.col("entity_id").alias("entity_a")), groups.select("company", "group_id", F.col("entity_id").alias("entity_b"))
    return a.join(b, ["company", "group_id"]).where("entity_a < entity_b").select("entity_a", "entity_b").distinct()
