"""Repeated spans against a plain loop over documents in order."""

import random

from contestry.llm.sentence_spans import SPAN_SENTENCES, SPAN_WORDS, remove_repeated_spans, sentences_of

SCHEMA = "doc_id long, text string, _span string"


def sentence(draw, n=None):
    return " ".join(f"w{draw.randrange(4000)}" for _ in range(n or draw.randrange(2, 12))) + draw.choice([". ", "! ", ", ", "\n"])


def brute(rows):
    """Every span as its words, first occurrence by id; null ids last and one document."""
    seen, out = {}, []
    for name, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = sentences_of(text or "")
        full = [i for i, p in enumerate(parts) if p[3]]
        gone, own = set(), set()
        for k in range(len(full)):
            for j in range(k + SPAN_SENTENCES, len(full) + 1):
                run = full[k:j]
                if sum(parts[i][3] for i in run) >= SPAN_WORDS:
                    span = " ".join(parts[i][2] for i in run)
                    if span in own or seen.get(span, name) != name:
                        gone.update(range(run[0], run[-1] + 1))
                    own.add(span)
                    break
        for span in own:
            seen.setdefault(span, name)
        kept = "".join((text or "")[p[0] : p[1]] for i, p in enumerate(parts) if i not in gone)
        out.append((repr(name), len(parts), len(gone), kept))
    return sorted(out)


def test_parts_cover_the_text():
    draw = random.Random(2)
    for text in ["", " ", "  a b. c", "x " * 500, "\n\na,\n b", *("".join(sentence(draw, 40) for _ in range(4)) for _ in range(20))]:
        parts = sentences_of(text)
        assert "".join(text[s:e] for s, e, _, _ in parts) == text
        assert " ".join(p[2] for p in parts if p[3]).split() == text.split()


def test_equal_to_brute_force(spark):
    draw = random.Random(3)
    passages = ["".join(sentence(draw) for _ in range(9)) for _ in range(4)]
    rows = []
    for i in range(60):
        own = [sentence(draw) for _ in range(draw.randrange(1, 12))]
        for _ in range(draw.randrange(3)):
            own.insert(draw.randrange(len(own) + 1), draw.choice(passages))
        rows.append((i, "".join(own)))
    rows += [(100 + i, passages[0]) for i in range(40)]
    rows += [(5, rows[5][1]), (None, passages[1]), (None, passages[1]), (200, None), (201, ""), (202, "v " * 30000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = remove_repeated_spans(docs).collect()
    assert sorted((repr(r.doc_id), r.n_sentences, r.n_removed, r.text) for r in got) == brute(rows)
    assert sum(r.n_removed for r in got) > 100


def test_passage_inside_other_sentences_goes_from_the_later_document(spark):
    draw = random.Random(5)
    passage = "".join(sentence(draw, 9) for _ in range(7))
    rows = [(i, f"own{i} start {passage}and own{i} end.", "") for i in (3, 1, 2)]
    got = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_removed == 0 and all(len(got[i].text.split()) < 25 for i in (2, 3))
    assert remove_repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_passage_of_fifty_words_is_missed_wherever_it_stands(spark):
    draw = random.Random(11)
    words = [f"{w}{sign}" for w in (f"w{i}" for i in range(3000)) for sign in ("", "", "", "", "", ",", ".")]

    def run(n, signs=True):
        return [w if signs else w.rstrip(",.") for w in draw.choices(words, k=n)]

    rows, planted = [], []
    for k in range(150):
        passage = run(draw.choice([50, 51, 60]), signs=k % 2 == 0)
        for name in (k, 1000 + k):
            head, tail = run(draw.randrange(40)), run(draw.randrange(40))
            rows.append((name, " ".join(head + passage + tail), ""))
        planted.append((1000 + k, len(head), passage, len(tail)))
    got = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    shares = []
    for name, head, passage, tail in planted:
        gone = head + len(passage) + tail - len(got[name].text.split())
        assert gone >= 20, (name, passage)
        shares.append(gone / len(passage))
    assert sum(shares) / len(shares) > 0.8
    assert all(got[k].n_removed == 0 for k in range(150))
