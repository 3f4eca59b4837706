from itertools import permutations

import pytest

from tilewright.llm import subjects as S

RULES = S.Rules(single={"loan": {"bank": 0.95}, "sick leave": {"work": 0.95}, "match": {"sport": 0.6}}, openings={"one may": 0.1, "the dispute": 1.0}, base=0.9)


def areas(text, **kw):
    return S.areas(text, RULES, RULES.matcher(), **kw)


def test_paragraphs_and_their_ends():
    text = "COURT loan\nHeld - loan; loan.\n[1] The loan was paid.\ngoes on here\n\nloan outside\n(2) Next one.\n§ 3 Third.\n4. Fourth\n5 Fifth"
    assert list(S.paragraphs(text)) == ["the loan was paid. goes on here", "next one.", "third.", "fourth", "fifth"]
    assert list(S.paragraphs(None)) == list(S.paragraphs(" \n ")) == []


SAID = "The dispute about the loan began."


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\v", "\x85", "\u2028", "\n\f", "\f"])
def test_paragraphs_at_any_line_end(end):
    assert list(S.paragraphs(end.join(["Court", f"1 {SAID}", "goes on", f"2 {SAID}"]))) == [SAID.lower() + " goes on", SAID.lower()]


@pytest.mark.parametrize("form", ["{})", "{}.)", "¶ {}", "§§ {}", "[ {} ]", "({})\n", "{}.\n\n", "1.{}", "[{}<|endoftext|>]", "</s> <unk>{}."])
def test_paragraphs_by_any_form_of_number(form):
    assert list(S.paragraphs("\n".join(f"{form.format(k)} {SAID}" for k in (1, 2)))) == 2 * [SAID.lower()] or form.endswith("\n")
    assert areas("\n".join(f"{form.format(k)} {SAID}" for k in (1, 2))) == ["bank"]


def test_paragraph_number_joined_to_its_text():
    assert list(S.paragraphs("1.The loan.\n2.The loan.")) == 2 * ["the loan."]


def test_numbers_in_running_text_begin_no_paragraph():
    text = f"1 {SAID} It was in\n1998 that the loan was paid, see\n[18] above, for\n2.5 loans.\n4 Fourth."
    assert [p[:12] for p in S.paragraphs(text)] == ["the dispute ", "fourth."]
    assert areas(text) == []


def test_special_tokens_inside_words():
    assert areas("1 The dispute about the lo<|endoftext|>an began.\n2 The dispute about the l</s> <unk>oan began.") == ["bank"]


def test_two_paragraphs_are_needed():
    assert areas("1 The dispute about the loan began.\n2 The dispute about a loan went on.") == ["bank"]
    assert areas("1 The dispute about the loan began. The loan was late.") == []
    assert areas("The loan is here and there.\nHeadnote: the loan is disputed.") == []


def test_openings_that_do_not_agree():
    assert areas("1 One may think of the loan there.\n2 One may think of the loan there.") == []


def test_phrases_do_not_cross_sentences():
    assert areas("1 He was sick. Leave was granted then.\n2 He was sick. Leave was granted then.") == []


def test_odd_texts():
    for t in (None, "", "  \n", "\x01", "1", "1 \x01 loan", "é" * 100000, "1 " + "word " * 50000):
        assert areas(t) == []
    invisible = "1 The dispute about the lo​an began.\n2 The dispute about the LOAN began."
    assert areas(invisible) == ["bank"]
    assert S.areas("1 a b c", S.Rules(), None) == [] if S.Rules().matcher() else True


TERMS = {
    "bank": ["loan tranche", "cheque", "deposit"],
    "farm": ["orchard", "heifer", "barley"],
    "work": ["overtime sheet", "apprentice", "severance"],
    "sport": ["goalkeeper", "rowing club", "stadium"],
}


def corpus(spark, n=480):
    """Rulings on one area each, with a headnote and one comparison about another."""
    names = sorted(TERMS)
    frames = ["The expert found that the {} was poor.", "It is common ground that the {} was sold.", "No record of the {} survives there."]
    docs, labels, truth = [], [], {}
    for i in range(n):
        area, other = names[i % 4], names[(i + 1 + i // 4 % 3) % 4]
        lines = ["Court of X", f"Held - the {TERMS[other][i % 3]}."]
        lines += [f"{k + 1} {frames[(i + k) % 3].format(TERMS[area][(i + k) % 3])} Costs follow the event." for k in range(4)]
        lines += [f"{k} One may think of the {TERMS[other][(i + k) % 3]} in another case." for k in (6, 7)]
        docs.append((i, f"D{i}", "\n".join(lines), "x"))
        truth[i] = area
        if i < n // 2:
            labels.append((i, area if i % 29 else other))
    labels += labels[:5] + [(None, "bank"), (1, None), (10**6, "bank")]
    docs += [(n, None, None, "x"), (n + 1, None, "", "x"), (n + 2, None, "1 nothing known here", "x")]
    return (
        spark.createDataFrame(docs, "doc_id long, docket string, text string, subject string"),
        spark.createDataFrame(labels, "doc_id long, subject string"),
        truth,
    )


def test_fit_and_score(spark):
    docs, labels, truth = corpus(spark)
    rules = S.fit(docs, labels)
    got = S.subject_areas(docs, rules).collect()
    held_out = {i: a for i, a in truth.items() if i >= 240}
    right = sum((r.doc_id, r.subject) in held_out.items() for r in got if r.doc_id >= 240)
    assert right >= 0.98 * len(held_out) and len([r for r in got if r.doc_id >= 240]) <= 1.02 * len(held_out)
    assert rules.openings["one may"] < 0.5 * rules.base
    comp = {r.subject: r.n_docs for r in S.composition(S.subject_areas(docs, rules), docs).collect()}
    assert comp["none"] >= 3 and sum(comp.values()) == docs.count()


def test_term_known_only_by_three_words(spark):
    say = "{} The expert found that the {} was sold."
    terms = {"farm": ["red iron gate"], "bank": ["red iron pot", "old iron gate"]}
    docs = [(i, f"D{i}", "\n".join(say.format(k + 1, t) for k, t in enumerate(2 * terms[a]))) for i, a in enumerate(20 * ["farm", "bank"])]
    labels = [(i, a) for i, a in enumerate(20 * ["farm", "bank"])]
    docs.append((99, "D99", "\n".join(say.format(k, "red iron gate") for k in (1, 2))))
    docs = spark.createDataFrame(docs, "doc_id long, docket string, text string")
    rules = S.fit(docs, spark.createDataFrame(labels, "doc_id long, subject string"))
    assert [tuple(r) for r in S.subject_areas(docs.where("doc_id = 99"), rules).collect()] == [(99, "farm")]


def test_three_items_say_other_than_any_two(spark):
    """Each of three terms, and any two of them, speak of farms; all three in a sentence do not."""
    terms = ("orchard", "heifer", "barley")
    texts = [(w, "farm") for w in permutations(terms, 2)] * 27 + [(w, "bank") for w in permutations(terms, 3)] * 3
    say = lambda w: "\n".join(f"{k} The {' lay near to the '.join(w)}." for k in (1, 2))
    docs = spark.createDataFrame([(i, f"D{i}", say(w)) for i, (w, _) in enumerate(texts)], "doc_id long, docket string, text string")
    rules = S.fit(docs, spark.createDataFrame([(i, a) for i, (_, a) in enumerate(texts)], "doc_id long, subject string"))
    machine = rules.matcher()
    assert all(S.areas(say(w), rules, machine) == ["farm"] for w in permutations(terms, 2))
    assert all("farm" not in S.areas(say(w), rules, machine) for w in permutations(terms, 3))


def test_rules_count_cases_and_come_from_the_trees():
    rules = S.prune([(["loan"], "bank", 8, 10), (["so:the dispute"], S.AGREES, 9, 10), (["a", "b", "loan"], "bank", 0, 40)])
    assert rules.single == {"loan": {"bank": (8 + S.PRIOR) / 11}} and rules.joint == {("a", "b", "loan"): {"bank": 0.02}}
    assert S.judge("the dispute", frozenset(["a", "b", "loan"]), rules)[1] < 0.1 < 0.7 < S.judge("the dispute", frozenset(["a", "loan"]), rules)[1]


def test_without_labels_or_documents(spark):
    docs, labels, _ = corpus(spark, 12)
    none = S.fit(docs, labels.limit(0))
    assert S.subject_areas(docs, none).count() == 0
    assert S.subject_areas(docs.limit(0), S.fit(docs, labels)).count() == 0


def test_held_out_accuracy_on_the_corpus(spark):
    """Four fifths of the cases fit, the others are told against their (partly wrong) labels."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/doc_label.parquet").distinct()
    case = docs.select("doc_id", F.coalesce("docket", F.col("doc_id").cast("string")).alias("case"))
    labels = labels.join(case, "doc_id").withColumn("out", F.pmod(F.xxhash64("case"), F.lit(5)) == 0)
    rules = S.fit(docs, labels.where(~F.col("out")))
    ids = labels.where("out").select("doc_id").distinct()
    got = {tuple(r) for r in S.subject_areas(docs.join(ids, "doc_id"), rules).collect()}
    want = {(r.doc_id, r.subject) for r in labels.where("out").collect() if r.subject != "none"}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9
