import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import leakage, pairs, reading, splitting

Q = "Why does the violin change when the choir is old?"
PAIR = "pair_id long, question string, answer string, loaded_at int"


@pytest.mark.parametrize("answer", ["", " \n", "\u200b", "**", "```\n```", "<think>\n\n</think>", "N/A", "null", "(empty)", "[no answer]", "Answer:", "**Answer:**", "…", "...", "-", "<|im_end|>", "\u3000", "\ufeff"])
def test_empty_answers(answer):
    assert pairs.is_empty(pairs.visible(answer))


@pytest.mark.parametrize("answer", ["No.", "None.", "0", "Twelve", "The violin", "1827", "x", "C"])
def test_short_answers_are_sound(answer):
    shown = pairs.visible(answer)
    assert not pairs.is_empty(shown) and not pairs.breaks_off(shown) and not pairs.in_other_language(Q, shown) and not pairs.copies_question(Q, shown)


def test_copies():
    for copy in (Q, Q.upper(), f"**{Q}**", f"You asked: {Q}", f"{Q}\n\n{Q}", Q.replace("violin ", ""), Q.replace("choir", "small choir"), f"Using the passage, answer: {Q}", f'  "{Q[:-1]}"'):
        assert pairs.copies_question(Q, pairs.visible(copy)), copy
    for sound in (f"{Q} Because the strings loosen with the years.", "The violin changes when the choir is old because both were kept in one hall.", "No", f"{Q} No."):
        assert not pairs.copies_question(Q, pairs.visible(sound)), sound


def test_languages():
    fr, de = "Les voyageurs qui traversaient la ville parlaient surtout de la laine.", "Die Leute erzählten, wie die Ernte plötzlich verschwand."
    assert pairs.in_other_language(Q, fr) and pairs.in_other_language(Q, de) and pairs.in_other_language(Q, "Каждый год мысль меняется.")
    assert not pairs.in_other_language("Translate into French: " + Q, fr) and pairs.in_other_language("Translate into French: " + Q, de)
    assert not pairs.in_other_language("Was ist die Ernte, und wie hängt sie mit der Stadt zusammen?", de)
    quoted = f'The line "{fr}" is often quoted here, and there is no record of how the violin came to be in that hall, although it was measured more than once.'
    assert not pairs.in_other_language(Q, quoted) and not pairs.in_other_language("", fr)


@pytest.mark.parametrize("tail", ["which was", "gave way to the", "(see the", "and the owners,", "a kind of inter-", "\n1. One is here.\n2. **", "\n3.", "\n```python\nfor x in y:\n  if", "\n\n| a | b |\n|---|---|\n| c |", "\n- One is here.\n- Another that was", "There are several causes:"])
def test_broken_answers(tail):
    assert pairs.breaks_off(pairs.visible("The violin was kept in the hall for years. " + tail))


@pytest.mark.parametrize("tail", ["The choir left.", 'He said "yes."', "\n\n* planet\n* beam of the hall", "\n```python\nx = 1\n```", "\n\n| a | b |\n|---|---|\n| c | d |", "\ncomet > moon > dust", "See https://shelf.example/x", "Done.<|im_end|>", "それは古い。"])
def test_finished_answers(tail):
    assert not pairs.breaks_off(pairs.visible("The violin was kept in the hall for years. " + tail))


def test_defects_of_a_table(spark):
    prompts = ["What is the tide?", "Who moved the lamp?", "How long does it take?", "Describe the old bridge.", "Give two reasons for it."]
    refusals = ["I'm sorry, but I can't help with that.", "Regrettably, I am not able to say anything about the {}. Please try another topic.", "The passage does not provide any information about {}."]
    sound = ["I'm sorry to say that the answer is a sad one. " + "The bridge was carried away by the water in the spring of that year, and nobody built it again. " * 2, "I cannot overstate how much depends on the lamp here. " + "It was carried to the old hall by the people of the town in a cold winter. " * 2]
    rows, want, k = [], {}, 0
    for i, p in enumerate(prompts * 3):
        for r in refusals:
            rows.append((k, p, r.format(["lamp", "tide", "bridge", "hall", "road"][i % 5]), 1))
            want[k] = "refusal"
            k += 1
        for s in sound:
            rows.append((k, p, s, 1))
            k += 1
    for q, a, d in [(prompts[0], None, "empty_answer"), (prompts[1], prompts[1], "copied_question"), (prompts[2], "Die Leute erzählten, wie die Ernte plötzlich verschwand.", "other_language"), (prompts[3], "The bridge was built in the year. It was", "truncated_answer"), (None, None, "empty_answer"), (None, "It was a long day in the old town.", None)]:
        rows.append((k, q, a, 1))
        if d:
            want[k] = d
        k += 1
    rows += [(0, *rows[0][1:3], 2), (None, "Q one here?", "", 1), (None, "Q one here?", "", 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, PAIR).withColumn("loaded_at", F.timestamp_seconds("loaded_at")).withColumn("defect", F.lit("clash")).withColumn("opening", F.lit(1))
    got = sorted(((r.pair_id, r.defect) for r in pairs.defective_pairs(df).collect()), key=str)
    assert got == sorted([*want.items(), (None, "empty_answer")], key=str)
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_a_refusing_cluster_needs_no_cue_of_the_answer(spark):
    asked = ["What is the tide?", "Who moved the lamp?", "How long does it take?", "Describe the old bridge."]
    rows = [(i, q, f"The passage does not provide any information about the {w}.", 1) for i, (q, w) in enumerate(zip(asked, ["sea", "oil", "way", "arch"]))]
    rows += [(10 + i, q, "I appreciate your interest; however, I can't help with that.", 1) for i, q in enumerate(asked)]
    rows += [(20, asked[0], "The passage does not provde any information about the moon.", 1)]  # no cue
    rows += [(21, asked[1], "The passage does not provde any information, but the keeper moved it in the spring of that year.", 1)]
    rows += [(22, asked[2], "I appreciate your interest; however, the walk takes two hours.", 1)]
    assert not any(pairs._CUE.search(a) for _, _, a, _ in rows[-3:])
    df = spark.createDataFrame(rows, PAIR).withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    got = {r.pair_id for r in pairs.defective_pairs(df).collect() if r.defect == "refusal"}
    assert got == {0, 1, 2, 3, 10, 11, 12, 13, 20}


def test_refusals_anywhere_in_an_answer_that_offers_nothing(spark):
    asked = ["What is the tide?", "Who moved the lamp?", "How long does it take?", "Describe the old bridge."]
    rows = [(i, q, "I can't help with that.", 1) for i, q in enumerate(asked)]
    policy = " The rules of this service do not leave room for requests of that kind, and our guidelines, which were written with the people who use it in mind, apply to every question alike. Please consult the policy of the service if you need to know more."
    rows += [(10, asked[0], "Thank you for asking. I appreciate your interest. I hope you are well. I can't help with that.", 1), (11, asked[1], "I can't help with that." + policy, 1)]
    rows += [(20, asked[0], "I can't help with that. The sea rises twice a day, drawn by the moon and by the sun.", 1), (21, asked[1], "The keeper moved it to the hall in spring. Thank you for asking. I can't help with that.", 1)]
    rows += [(22 + i, q, f"The {w} cannot be established independently of the other, since both procedures share an error whose magnitude exceeds 0.5 here.", 1) for i, (q, w) in enumerate(zip(asked, ["first", "second", "first", "second"]))]
    df = spark.createDataFrame(rows, PAIR).withColumn("loaded_at", F.timestamp_seconds("loaded_at"))
    assert {r.pair_id for r in pairs.defective_pairs(df).collect() if r.defect == "refusal"} == {0, 1, 2, 3, 10, 11}


def test_a_question_repeated_often_is_a_copy():
    assert pairs.copies_question(Q, " ".join([Q] * 9)) and pairs.copies_question(Q, "You asked: " + "\n".join([Q] * 6))
    assert not pairs.copies_question(Q, " ".join([Q] * 9) + " Because the strings loosen with the years.")


def test_minhash_is_verified(spark):
    words = "the excerpt simply doesnt cover"
    found = spark.createDataFrame([(f"{words} {t}"[:36], n) for n, t in enumerate(["lamp", "tide", "bay", "rope"])] + [("a wholly different opening", 9)], "opening string, n long").withColumn("weight", F.col("n") + 1)
    links = pairs.templates(found).collect()
    assert all(len(pairs.grams(a) & pairs.grams(b)) >= pairs.ALIKE * len(pairs.grams(a) | pairs.grams(b)) for a, b in links)
    assert {a for a, b in links if b.endswith("rope")} == {f"{words} {t}" for t in ("lamp", "tide", "bay", "rope")}


def test_rare_openings_meet_in_a_bucket_that_another_leads(spark, monkeypatch):
    def one_bucket(batches):
        for pdf in batches:
            yield pdf.assign(band=[[7]] * len(pdf))

    monkeypatch.setattr(pairs, "_with_bands", one_bucket)
    rare = ["i must leave this one aside aa", "i must leave this one aside bb"]
    found = spark.createDataFrame([("what makes the town remarkable", 50), ("nobody here may speak of it", 7), (rare[0], 1), (rare[1], 1), (rare[1] + "b", 90)], "opening string, n long")
    found = found.withColumn("weight", F.when(F.col("n") == 90, 0).otherwise(F.col("n")))  # the last links, but stands for none
    assert {tuple(r) for r in pairs.templates(found).collect() if r.opening != r.template} == {tuple(rare), (rare[1] + "b", rare[1])}


def test_links_of_openings_against_brute_force():
    """Every hundredth opening against all: of those at ALIKE or above, the bands bring nine of ten together at least."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(60)]
    some = sorted({"".join(rng.choice("abcdefgh ") if rng.random() < 0.05 else c for c in rng.choice(stems)).strip() for _ in range(3000)})
    bands, sets = pairs.bands_of(some), [pairs.grams(o) for o in some]
    met = alike = 0
    for i in range(0, len(some), 100):
        for j in range(len(some)):
            if j != i and len(sets[i] & sets[j]) >= pairs.ALIKE * len(sets[i] | sets[j]):
                alike += 1
                met += bool((bands[i] == bands[j]).any())
    assert alike > 100 and met >= 0.9 * alike


def test_a_template_needs_unlike_prompts_unless_it_is_known(spark):
    refusal = "The keeper of these notes has nothing in them about that, sorry."
    alike = [(i, f"Who moved the old brass lamp to the great northern harbour {'again' * (i % 2)}?", refusal, 1) for i in range(4)]
    unlike = [(i, q, refusal, 1) for i, q in enumerate(["What is the tide?", "Who moved the lamp?"])]
    known = [(0, "What is the tide?", "I cannot answer this question.", 1)]
    found = lambda rows: pairs.defective_pairs(spark.createDataFrame(rows, PAIR).withColumn("loaded_at", F.timestamp_seconds("loaded_at"))).count()
    assert [found(rows) for rows in (alike, unlike, known)] == [0, 2, 1]


# --- leaked items -----------------------------------------------------------------------------------------------
ITEMS = [
    (1, "Answer the following question. Two letters from Talbridge mention Norvane, a spindle, and a debt of 66 marks. Only Hesrane noticed that the indigo was warm. What did Hesrane think of it?"),
    (2, "Answer the following question. Every seventh night Bevuntov climbed from Hestov to inspect the ordinary concert. Both were fined 62 marks for the brown key. State one reason why."),
    (3, "A train of carts left Rylzin with 44 kilograms of essence aboard. The quarrel ended when the bud was explained in public. Name the object that changed hands twice."),
    (4, "one"), (5, None), (6, ""),
]
FILL = "The harbour was quiet for most of the year and the boats lay on the sand. "


def test_leaks_are_found_whatever_the_typography(spark):
    t = ITEMS[0][1]
    words = t.split()
    half = " ".join(words[: len(words) * 2 // 3])
    docs = {
        10: FILL * 9 + t + FILL * 9, 11: t.upper(), 12: "\n".join(f"> {' '.join(words[i : i + 5])}" for i in range(0, len(words), 5)), 13: "<p>" + " ".join(f"<i>{w}</i>" if i % 3 else w for i, w in enumerate(words)).replace(" of ", "&nbsp;of ") + "</p>",
        14: t.replace("spindle", "spin-\ndle").replace("warm", "wa\u00adrm").replace("letters", "let\u2060ters"), 15: " ".join([*words[:14], "(" + FILL + ")", *words[14:]]), 16: FILL + half, 17: " ".join(w if i % 9 else "then " + w for i, w in enumerate(words)),
        20: "Answer the following question. " + FILL, 21: "Names: Talbridge, Norvane, Hesrane, Answer.", 22: " ".join(sorted(words)), 23: FILL * 40, 24: None, 25: "", 26: " ".join(words[:12]),
        30: t + " " + FILL + ITEMS[2][1],
    }
    df = spark.createDataFrame(list(docs.items()) + [(10, docs[10])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS + [ITEMS[0]], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect())
    assert got == [(i, 1) for i in (10, 11, 12, 13, 14, 15, 16, 17)] + [(30, 1), (30, 3)]
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


def test_items_of_any_length_interruption_and_script():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bdfgklmnprst", k=3)) + rng.choice("aeiou") + rng.choice("lmnrs")
    long, short = " ".join(word() for _ in range(1500)), [word() for _ in range(60)]
    cyrillic = "Каждую седьмую ночь старый сторож поднимался на башню и считал огни над рекой"
    chinese = "每年春天老船长都会把灯塔上的旧灯擦亮然后写信给远方的朋友"
    index = leakage.ItemIndex([(1, long), (2, " ".join(short)), (3, cyrillic), (4, chinese)])
    assert [i for i, n, w in index.leaks(FILL * 20 + long + FILL * 20) if n >= 0.5 and w >= 0.5] == [1]
    apart = " ".join([*short[:22], FILL * 10, *short[22:44]])
    assert [i for i, n, w in index.leaks(FILL * 9 + apart + FILL * 9) if n >= 0.5 and w >= 0.5] == [2]
    for text, i in ((cyrillic.upper(), 3), (chinese, 4)):
        assert [k for k, n, w in index.leaks(FILL + text + FILL) if n >= 0.5 and w >= 0.5] == [i]


def test_tags_part_words_unless_they_stand_inside_one():
    assert leakage.words_of("<p>one</p><p>two<br>three</p> f<b>ou</b>r <td>five</td><td>six</td> \\emph{seven} <em class='x'>eig</em>ht") == "one two three four five six seven eight".split()
    assert leakage.words_of("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_shards_find_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, FILL + t + FILL) for i, t in ITEMS[:3]], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(leakage, "MAX_ITEMS", 2)
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(df, items).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_wand_retrieves_what_brute_force_does():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    index = leakage.ItemIndex([(i, " ".join(rng.choices(vocabulary, k=rng.randint(2, 30)))) for i in range(150)])
    known = list(index.postings)
    for _ in range(200):
        terms = set(rng.sample(known, rng.randint(1, 40)))
        threshold = rng.choice([0.05, 0.1, 0.2, 0.5])
        score = np.zeros(len(index.ids))
        for t in terms:
            at, impact, *_ = index.postings[t]
            score[at] += impact
        got = set(index.retrieve(terms, threshold))
        near = {i for i in range(len(score)) if abs(score[i] - threshold) < 1e-9}
        assert got - near == {i for i in range(len(score)) if score[i] >= threshold} - near


# --- reading levels -------------------------------------------------------------------------------------------
def passage(level, rng, n=14):
    if level == 1:
        return " ".join(f"The {rng.choice(['cat', 'dog', 'sun'])} is {rng.choice(['big', 'red', 'old'])}." for _ in range(n * 2))
    if level == 2:
        return " ".join(f"Some children learn about the {rng.choice(['harbour', 'garden', 'kitchen'])} when they visit the town in spring." for _ in range(n))
    if level == 3:
        return " ".join(f"Although the {rng.choice(['vinegar', 'harbour'])} had been measured for years, few visitors noticed how slowly the {rng.choice(['onion', 'channel'])} had shaped the market around it." for _ in range(n))
    return " ".join(f"Comparative examination of {rng.choice(['atmospheric', 'interstellar'])} refraction necessitates a methodological reformulation of institutional frameworks, notwithstanding considerable disagreement concerning the parametrisation thereof." for _ in range(n))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, 1 + i % 4, passage(1 + i % 4, rng)) for i in range(80)] + [(900, None, "x"), (901, 2, None), (902, 2, "")], "ref_id long, level int, text string")


def test_levels_of_documents(spark, graded):
    rng = random.Random(4)
    rows = [(i, "# Heading\n\n" + passage(1 + i % 4, rng, 20), "en", "book") for i in range(40)]
    rows += [(100, passage(1, rng, 40), "EN", "book"), (101, passage(1, rng, 40), "en", "code"), (102, "short text.", "en", "book"), (103, None, "en", "book"), (104, "x" * 700, "en", "book"), (105, passage(2, rng, 40), "en", None), (106, passage(2, rng, 40), None, "book")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, doc_format string").withColumn("level", F.lit("clash"))
    out = {r.doc_id: r for r in reading.reading_levels(df, graded).collect()}
    assert set(out) == set(range(40)) | {104, 105}
    assert sum(out[i].level == 1 + i % 4 for i in range(40)) >= 38
    assert out[104].level == 1 and out[104].unfamiliar is None and out[105].level == 2
    assert reading.reading_levels(df.limit(0), graded).count() == 0
    with pytest.raises(ValueError):
        reading.reading_levels(df, graded.limit(0))


def test_demanding_sentences_are_measured():
    rank = {w: i for i, w in enumerate("the of and a is to in dog sat".split())}
    hard = "The photometric calibration of interstellar refraction necessitates considerable methodological reformulation and a parametrisation."
    easy = "The dog sat in the dog and the dog sat."
    foreign = "Les voyageurs qui traversaient la ville parlaient surtout de la laine."
    x = reading.features(f"{easy} {hard}", rank)
    assert x[-1] > reading.features(easy, rank)[-1] and x[0] > 0.2
    assert (reading.features(f"{easy} {foreign}", rank) == reading.features(easy, rank)).all()
    assert reading.features("Photometric calibration necessitates reparametrisation.", rank) is not None


def test_running_text_only():
    text = "# Head line here\n\nCHAPTER I. THE START\n\nALICE. This is what she\nsaid to them. It was late.\n\n| a | b |\n|---|---|\n\n```\ncode here.\n```\n\nNames in the register: Ann, Bob\n\n[Link](http://x.y/z) words stand here too."
    got = [" ".join(s) for s in reading.sentences_of(text)]
    assert got == ["This is what she said to them", "It was late", "Link words stand here too"]
    assert [" ".join(s) for s in reading.sentences_of("The first is here\nThe second is there\nThe third is gone")] == ["The first is here", "The second is there", "The third is gone"]
    assert reading.sentences_of("") == []


def test_familiar_words_by_documents(spark):
    df = spark.createDataFrame([("The cat sat on a mat. The cat ran.",), ("The dog sat on a rug.",), (None,)], "text string")
    got = {r.word: r.n_docs for r in reading.familiar_words(df).collect()}
    assert got["sat"] == 2 and got["cat"] == 1 and got["the"] == 2


@pytest.mark.parametrize("unit", [".", " ", ". ", "\n ", "x", "(", "-\n", "<a", "| ", "**", "́", "👩‍", "A ", "1. ", "é, ", "```\n", "。", "&amp;", "[x](", "[", "\\_", "?!", ".)", "\"."])
def test_very_long_texts_of_any_matter_end_soon(unit):
    import time

    text = (unit * 150_000)[:150_000]
    began = time.monotonic()
    shown = pairs.visible(text)
    pairs.is_empty(shown), pairs.copies_question(Q, shown), pairs.in_other_language(Q, shown), shown and pairs.breaks_off(shown), pairs.openings(Q, shown)
    leakage.ItemIndex([(1, ITEMS[0][1])]).leaks(text)
    reading.features(text, {"a": 1})
    pieces = splitting.split_text(text)
    assert "".join(text[a + o : b] for a, b, o in pieces) == text and all(b - a <= splitting.LIMIT for a, b, _ in pieces)
    assert time.monotonic() - began < 12
