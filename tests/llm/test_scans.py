import pickle
import random

from pyspark.sql import functions as F

from lodestrata.llm.scans import RULES, Furniture, Lexicon, alike, errors, keys_of, left_part, line_key, repair_page, repair_pages, skeleton
from lodestrata.session import table

WORDS = {w: 500 for w in "the assessor checks long-term third-party plans every quarter for programme planned million haupt- und nebenstandorte melden 2019 of energy water".split()} | {"term": 20, "third": 20, "party": 20}
LEX = Lexicon(WORDS)


def test_sources_are_complete_for_errors():
    for bad, good in {"evcry": "every", "prograrnme": "programme", "p|anned": "planned", "milhon": "million", "asse5sor": "assessor", "pl@nned": "planned", "qiiarter": "quarter", "2o19": "2019", "vvater": "water", "p1anried": "planned"}.items():
        assert LEX.misread(bad) == (good,), bad
    for good in ("every", "CO2e", "FY35", "zebra", "12,500"):
        assert not LEX.misread(good), good


def test_errors_beyond_two_and_unknown_signs():
    words = Lexicon({"sustainability": 900, "remuneration": 900, "assessor": 900})
    assert words.misread("sustai1iabil1ty") is None and words.misread("5ustainabi1itv") is None
    assert words.misread("susta1nab1l1ty") == ("sustainability",) and words.misread("remurieratiori") == ("remuneration",)
    assert words.misread("asse7sor") == ("assessor",) and not words.misread("assessor1") and not words.misread("as7e4sor")


def test_keys_meet_whatever_errors_explain():
    assert all(alike(r) == alike(w) for r, w in RULES)
    rng = random.Random(4)
    vocabulary = ["sustainability", "groundwater", "commitment", "million", "harm", "billing", "überprüfung"]
    lexicon = Lexicon(dict.fromkeys(vocabulary, 999))
    for _ in range(300):
        word = token = rng.choice(vocabulary)
        for _ in range(rng.randrange(1, 3)):
            read, printed = rng.choice([r for r in RULES if r[1] in token] or [("", "")])
            if printed:
                at = rng.choice([i for i in range(len(token)) if token.startswith(printed, i)])
                token = token[:at] + read + token[at + len(printed) :]
        if rng.random() < 0.3:
            at = rng.randrange(1, len(token) - 1)
            token = token[:at] + rng.choice("47$") + token[at + 1 :]
        e = errors(token, word)
        found = {w: u for u, _, w in lexicon.candidates(token)}
        assert (found.get(word) == e) or (e is not None and e > max(2, len(token) // 4)) or token == word
        if e:
            assert keys_of(token, False) & keys_of(word, True), (token, word)


def test_very_long_words():
    long = "abcdefghi" * 5000
    words = pickle.loads(pickle.dumps(Lexicon({long: 99, "energy": 99})))
    assert words.counts[long] == 99 and words.misread("en3rgy") == ("energy",)
    assert errors(long.replace("g", "9", 3), long) == 3 and errors(long, "abc") is None


def test_encoded_data_lists_and_long_words():
    assert LEX.is_sound("QmFzZTY0+/ZvbyBiYXIgZm9v9g==") and LEX.is_sound("12|13|14|15") and not LEX.is_sound("energy/vvater")
    assert left_part("x " + "a" * 300, 302) == "a" * 300 and left_part("a -", 3) == ""


def test_breaks():
    assert LEX.hyphenated("pro", "-", "gramme") and LEX.hyphenated("Qu", "\xad", "arter")
    assert not LEX.hyphenated("third", "-", "party") and not LEX.hyphenated("Haupt", "-", "und")


def test_page():
    text = "<header>Acme | Review</header>\r\n\r\nThe asse5sor checks long-\r\nterm plans every qu-\r\narter for the pro¬\r\ngramme.\r\n\r\n- the water\r\n- the energy\r\n\r\n- 14 -"
    got, kinds = repair_page(text, ["14", None], {line_key(skeleton("Acme | Review"))}, LEX)
    assert got == "The assessor checks long-term plans every quarter for the programme.\n\n- the water\n- the energy"
    assert kinds == {"header", "hyphenation", "misread", "page_number"}
    assert repair_page("", [None], set(), LEX) == ("", set())


def test_furniture():
    assert Furniture("Acme Review 2019 | 07\n\nText of the page.", ["7"]).numbers == [0]
    assert Furniture("33\nGWh\n\nText of the page.", ["7"]).numbers == []
    assert Furniture("Text of the page.\n\niv", [None]).numbers == [2]
    assert Furniture("Text of the page.\n\n12 / 41", ["012"]).numbers == [2]
    assert len(Furniture("\n".join(f"Line {k} " + "of a very long header " * 9 for k in range(7)) + "\n\nText.", [None]).headers) == 7
    assert not Furniture("# Heading\n\nText.", ["1"]).headers
    assert skeleton("<header>E1lipta  Review</header>") == skeleton("Ellipta Review")


def test_frame(spark):
    body = "The assessor checks the plans every quarter. " * 6
    rows = [(f"p{i}", "f", f"Acme Review\n\n{body}\n\n{i}", str(i), i, "x") for i in range(1, 6)]
    rows += [("n", "f", None, None, None, "x"), ("e", None, "", None, None, "x"), (None, "g", "The assess0r checks.", None, None, "x"), ("p1", "f", f"Acme Review\n\n{body}\n\n1", "1", 1, "x"), ("long", "g", body * 800, None, None, "x")]
    df = spark.createDataFrame(rows, "id string, source_file string, text string, page_number_raw string, page_number int, noise string")
    got = [(r.id, tuple(r.noise)) for r in repair_pages(df).collect()]
    assert sorted(got, key=str) == sorted([(f"p{i}", ("header", "page_number")) for i in (1, 1, 2, 3, 4, 5)] + [("e", ()), (None, ("misread",)), ("long", ())], key=str)
    assert repair_pages(df.where("false")).count() == 0


def test_held_words_and_repeated_corpora_change_nothing(spark):
    chunks = table(spark, "/root/testdata/sf0.01", "chunks").select("id", "source_file", "text", "page_number_raw", "page_number")
    found = lambda d, **k: {tuple(r) for r in repair_pages(d, **k).select("id", F.explode("noise").alias("noise")).distinct().collect()}
    want = found(chunks)
    assert want and found(chunks, held=60) == want

    def pages(times):
        body = "The assessor checks sustainability every quarter. " * 9
        rows = [(f"{t}-{k}", f"f{t}-{k}", body, None, None) for t in range(times) for k in range(10)]
        rows += [(f"{t}-bad", f"f{t}", "The assessor checks susta1nabi1ity.", None, None) for t in range(times)]
        return spark.createDataFrame(rows, chunks.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " ").replace(",", ", "))

    for times in (1, 10):
        assert {n for _, n in found(pages(times))} == {"misread"} == {n for _, n in found(pages(times), held=1)}
