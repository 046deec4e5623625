import random

import numpy as np

from evidentia.llm import language_id as li

SYLLABLES = {"aa": "ba be bi bo bu", "bb": "tza tze tzi tzo tzu", "cc": "lé lè là lù lî"}


def text(r, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed, n=90):
    r = random.Random(seed)
    return [(k, text(r, lang, r.randint(5, 80)), lang) for k, lang in enumerate(r.choice(sorted(SYLLABLES)) for _ in range(n))]


def phrases(sample, words):
    """Greedy longest matches by search, within segments."""
    count = 0
    for low in range(0, len(words), li.SEGMENT):
        part, at = words[low : low + li.SEGMENT], 0
        while at < len(part):
            to = at + 1
            while to < len(part) and part[at : to + 1] in sample:
                to += 1
            count += 1
            at = to
    return count


def test_phrases_are_greedy_longest_matches():
    r = random.Random(1)
    sample = text(r, "aa", 60)
    letters = "".join(sorted(set(sample)))
    model = li.Model(["aa"], letters, [])
    model.steps = [li.suffix_automaton(model.encode(sample), len(letters) + 1)]
    texts = [text(r, lang, n) for lang in SYLLABLES for n in (1, 3, 40, 900)] + ["", "b", "zzz"]
    expected = [phrases(sample, t) for t in texts]
    assert model.phrases(texts)[:, 0].tolist() == expected


def test_the_automaton_accepts_all_substrings_and_no_others():
    codes = np.array([1, 2, 1, 1, 2, 3, 1, 2], dtype=np.uint8)
    step = li.suffix_automaton(codes, 4)
    inside = {tuple(codes[a:b]) for a in range(8) for b in range(a + 1, 9)}

    def accepted(word):
        state = 0
        for c in word:
            state = step[state, c]
            if state < 0:
                return False
        return True

    for n in range(1, 5):
        for k in range(3**n):
            word = tuple(1 + k // 3**i % 3 for i in range(n))
            assert accepted(word) == (word in inside)


def test_held_out_accuracy_and_the_undetermined(spark, documents):
    train, test = corpus(1), corpus(2)
    model = li.learn(documents(train + [(900, None, "aa"), (901, "…123", "bb"), (902, "x", None)]))
    odd = [(500, None), (501, ""), (502, "12 % …"), (503, "BA bE"), (504, text(random.Random(3), "bb", 30000)), (None, "lélè")]
    found = {r.doc_id: r for r in li.predict(documents([t[:2] for t in test] + odd), model).collect()}
    assert len(found) == len(test) + len(odd)
    assert sum(found[k].lang_pred == lang for k, _, lang in test) >= 0.97 * len(test)
    assert [found[k].lang_pred for k in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "aa", "bb", "cc"]
    assert all(0 <= r.lang_score <= 1 for r in found.values()) and found[500].lang_score == 0


def test_labels_and_sources_are_not_read_and_order_does_not_matter(documents):
    rows = corpus(4)
    one, two = li.learn(documents(rows, parts=1)), li.learn(documents(rows[::-1] * 2, parts=5))
    assert one.languages == two.languages and all((a == b).all() for a, b in zip(one.steps, two.steps))


def test_nothing_to_learn_and_no_rows(documents):
    model = li.learn(documents([(1, "some text", None)]))
    assert [r.lang_pred for r in li.predict(documents([(1, "some text")]), model).collect()] == ["und"]
    assert li.predict(documents([]), model).collect() == []


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.learn(table.filter("doc_id % 2 = 0"))
    found = li.predict(table.filter("doc_id % 2 = 1"), model)
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()


def test_every_sampled_letter_counts_and_unseen_ones_match_nothing(documents):
    """Two languages of thousands of letters each, and texts of letters that neither has."""
    r = random.Random(4)
    own = {"xx": [chr(c) for c in range(0x4E00, 0x5600)], "yy": [chr(c) for c in range(0x5600, 0x5E00)]}
    write = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    rows = [(k, write(own[lang], 150), lang) for k in range(200) for lang in own]
    model = li.learn(documents(rows))
    assert len(model.letters) > 3000
    assert all((model.encode(t) > 0).all() for _, t, _ in rows)
    texts = [write(own[lang], 80) for lang in own] + [rows[0][1] + "a" + rows[1][1], write([chr(c) for c in range(0xAC00, 0xD000)], 300)]
    found = model.phrases(texts)
    pieces = {lang: [t for _, t, x in rows if x == lang] for lang in own}
    inside = lambda part, lang: any(part in t for t in pieces[lang])
    for k, text in enumerate(texts):
        for column, lang in enumerate(model.languages):
            at = count = 0
            while at < len(text):
                to = at + 1
                while to < len(text) and inside(text[at : to + 1], lang):
                    to += 1
                count, at = count + 1, to
            assert found[k, column] == count
    assert (found[3] == 300).all()
    predicted = {row.doc_id: row.lang_pred for row in li.predict(documents([(k, rows[k][1][10:90], rows[k][2]) for k in (0, 1)]).drop("lang"), model).collect()}
    assert predicted == {0: "xx", 1: "yy"}
