import random

from lodestrata.llm import pairs
from lodestrata.llm.pairs import _sentence_ends, breaks_off, defective_pairs, is_empty, is_refusal, lcs, requested_languages, words


def is_copy(q, a):
    return pairs.is_copy(words(q or ""), words(a))



def test_parts():
    for a in (None, "", " \n", "​", "N/A", "-", "[]", "```\n```", "<answer></answer>", "Answer:", "null", "..."):
        assert is_empty(a), a
    assert not is_empty("42 %") and not is_empty("Yes.") and not is_empty("Null findings rose to 4.")
    assert lcs(list("abcde"), list("xaxcxe")) == 3
    q = "What did Acme report about water in 2023?"
    assert is_copy(q, q.upper()) and is_copy(q, "You asked: " + q) and is_copy(q, f"{q} {q}") and is_copy(q, f"“{q}”")
    assert not is_copy(q, q + "\nWells at Duskley pumped 16 megalitres, 39 % less than in 2012.") and not is_copy(None, "x")
    assert is_refusal(q, "> I'm sorry, but I can't help with that question.") and is_refusal(q, "Hm. Lo siento, no puedo responder a esa pregunta.")
    assert not is_refusal(q, "The auditors were unable to visit one site. Water use at Acme fell by 4 % in 2023, the report says. Wells were closed.")
    assert not is_refusal(q, "No answer came from two suppliers, yet the rest is complete. Acme pumped less water.")
    assert requested_languages("Describe it. Please answer in German.") == {"de"} and requested_languages("Bitte auf Englisch antworten") == set()


#: Wordings that neither the templates nor the tables have.
HELD_OUT = """I'm afraid I cannot respond to that.
I am not permitted to comment on matters of litigation.
I can't really say, based on these pages.
We regret that we are unable to answer this.
I do not have sufficient data to give you a figure.
I couldn't find any mention of this in the report.
The documents provided do not contain any information about it.
The context gives no answer to that.
No relevant information was found.
This question lies outside the scope of my capabilities.
I must respectfully decline to answer.
I would prefer not to discuss this.
That is not something I can help with.
I never discuss such matters, and I can not tell you more.
Leider kann ich Ihnen hierbei nicht weiterhelfen.
Ich darf mich zu diesem Thema nicht äußern.
Mir liegen hierzu leider keine Angaben vor.
Der Kontext enthält hierzu keine Hinweise.
Je regrette, mais je ne suis pas en mesure de répondre.
Nous ne pouvons pas vous aider sur ce point.
Je n'ai trouvé aucune information là-dessus.
Les documents ne mentionnent aucun élément à ce propos.
Lamentablemente no puedo dar una respuesta.
No tengo datos sobre eso.
El informe no ofrece ninguna respuesta al respecto.
No estoy autorizado a comentar este asunto.""".split("\n")
ANSWERS = """The plant could not be visited in winter, and output fell by 4 %.
We did not report scope 3 emissions in 2019.
Ich habe 2019 nicht weniger als vier Brunnen gezählt.
No supplier was found to use forced labour.
La empresa no contiene sus emisiones desde 2012.
Aucun site n'a dépassé le seuil en 2020.
The committee declined to answer shareholders in May, then published all figures.
Outside the scope of the audit, three sites were visited.""".split("\n")


def test_refusals_in_wordings_held_out():
    missed = [a for a in HELD_OUT if not is_refusal("What did the town do about its wells?", a)]
    assert len(missed) <= 1, missed
    assert not [a for a in ANSWERS if is_refusal("What did the town do about its wells?", a)]


def test_every_sentence_counts_at_any_length():
    q = "What did Acme report about water in 2023?"
    assert is_refusal(q, "Thank you. " * 3 + "I cannot answer that.") and is_refusal(q, "Thank you. " * 5 + "I cannot answer that.")
    assert not is_refusal(q, "I cannot answer that. " + "The wells of the town were closed in spring by the council. " * 4)
    for n in (200, 400, 420, 600, 5000):
        asked = [f"w{k}" for k in range(n)]
        back = [w for k in range(n - 20, -1, -20) for w in asked[k : k + 20]]
        assert not pairs.is_copy(asked, back) and pairs.is_copy(asked, asked[:-2]) and pairs.is_copy(asked, asked * 2)


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], (diagonal + 1 if x == y else max(row[j], row[j - 1]))
        assert lcs(a, b) == row[-1]


def test_breaking_off():
    for a in ("It rose,", "It rose (acme, p.", "- a rose.\n-", "| a | b |\n|---|---|\n| 1", "```\nx"):
        assert breaks_off(a) is True, a
    for a in ("It rose.", "It rose [acme 3]", "It rose (acme, p. 3)", "FY35", "| a | b |\n|---|---|\n| 1 | 2 |"):
        assert breaks_off(a) is False, a
    assert breaks_off("The wells of the town were closed by the reg") is None


def test_ellipsis_breaks_off():
    for a in ("A new target for species ...", "Reviewers looked at encryption at…", "It rose from 3 to . . .", "**Wells pumped...**", "Vendors that failed ... [acme 3]", "It rose. ..."):
        assert breaks_off(a) is True, a
    for a in ("It rose ... to 4.", "Wells … were closed!"):
        assert breaks_off(a) is False, a
    assert not any(ended for _, ended in _sentence_ends(["Reviewers looked at encryption at ...", "The picture for the..."]))


def test_counts_of_wanted_endings(spark):
    answers = ["The wells, were closed by 12 men. It rose 3 % [x 1]!", "Closed by men", None, "x.", "Über die Maße."]
    whole = {(k, e): n for (k, e), n in _sentence_ends(answers).items()}
    df = spark.createDataFrame([(a,) for a in answers], "answer string")
    ends = spark.createDataFrame([("by # men",), ("die masse",), (None,)], "ending string")
    got = {r.ending: (r.ended, r.going_on) for r in pairs.ending_counts(df, "answer", ends).collect()}
    assert got["by # men"] == (1, 0) and all((whole.get((k, True), 0), whole.get((k, False), 0)) == v for k, v in got.items())
    assert {k for k, _ in whole if k.split(" ")[-1] in ("men", "masse")} <= set(got)


def test_ellipsis_in_frame(spark):
    samples = spark.createDataFrame([("en", "The wells were closed and the water was pumped out of the town by the council")], "lang string, sample_text string")
    rows = [(1, "What did the council do?", "The wells were closed. A new target for ..."), (2, "What did the council do?", "The wells were closed."), (3, "What did the council do?", "..."), (4, "What did the council do?", "What did the council do? ...")]
    got = {tuple(r) for r in defective_pairs(spark.createDataFrame(rows, "qa_id long, question string, answer string"), samples).collect()}
    assert got == {(1, "truncated"), (3, "empty"), (4, "copy")}


def test_frame(spark):
    samples = spark.createDataFrame([("en", "The wells were closed and the water was pumped out of the town by the council"), ("de", "Die Brunnen wurden geschlossen und das Wasser wurde aus der Stadt gepumpt"), (None, "x")], "lang string, sample_text string")
    q = "What did the council do with the water of the town?"
    full = "The council closed the wells of the town and pumped the water away."
    rows = [(1, q, full), (1, q, full), (2, q, None), (3, q, q), (4, q, "Die Brunnen der Stadt wurden geschlossen und das Wasser wurde gepumpt."), (5, q + " Please answer in German.", "Die Brunnen der Stadt wurden geschlossen und das Wasser wurde gepumpt."), (6, q, "The council closed the wells of the town and pumped the wat"), (7, q, full[:-1]), (8, None, "x " * 50_000 + "."), (None, q, ""), (9, q, "I am unable to answer this from the pages supplied.")]
    rows += [(100 + i, q, f"In {2000 + i}, {full}") for i in range(4)]
    rows += [(200 + i, q, f"Item {'abcd'[i]}: {full}") for i in range(4)]
    df = spark.createDataFrame(rows, "qa_id long, question string, answer string").withColumnRenamed("qa_id", "defect")
    got = {tuple(r) for r in defective_pairs(df.distinct(), samples, id_col="defect").toDF("id", "kind").collect()}
    assert got == {(2, "empty"), (3, "copy"), (4, "other_language"), (6, "truncated"), (None, "empty"), (9, "refusal")}
    assert defective_pairs(df.where("false"), samples, id_col="defect").count() == 0
