import random
import re

from tidemill.llm import licenses

from .fixtures import docs, edge_rows


def brute(text):
    """The base columns by looking at every place."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_against_brute_force(spark):
    rng = random.Random(3)
    pieces = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC BY", "All  Rights\nReserved", "GENERAL PUBLIC-LICENSE", "the", "é", "mit", "x1"]
    rows = edge_rows() + [(100 + i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(300)]
    got = licenses.op5(docs(spark, rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_templates(spark):
    texts = {
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "the permission to use a general license": "",
        "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    }
    noise = [(1000 + i, "the of under " + "word " * (i % 9), "en", "s") for i in range(60)]
    rows = [(i, f"Some text before. {t} And after", "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.labels for r in licenses.op5(docs(spark, rows + noise)).collect() if r.doc_id < 1000}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert licenses.op5(docs(spark, [])).collect() == []


def test_names_lines_and_edited_texts(spark):
    """SPDX lines, a bare name, a text with words put in between its phrases, and one without its second phrase, which
    decides and so makes it another text."""
    full = next(t for label, t, p in licenses.TEMPLATES if label == "mit" and "|" in p)
    edited = full.replace("any person", "any natural or legal person")
    cut_off = full.replace("to deal in the software without restriction", "to do what they like")
    texts = ["// SPDX-License-Identifier: GPL-3.0-only", "MIT License", edited, "x " * 500 + full, "identifier of a license", "SPDX-License-Identifier: nothing known", cut_off]
    noise = [(100 + i, f"some words of a text number {i} in the corpus", "en", "s") for i in range(200)]
    got = {r.doc_id: r.labels for r in licenses.op5(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + noise)).collect()}
    assert [got[i] for i in range(len(texts))] == ["gpl-3", "mit", "mit", "mit", "", "", ""]
    assert not any(got[r[0]] for r in noise)


def test_more_names(spark):
    texts = {
        "Mozilla Public License, version 2.0": "mpl-2.0",
        "Artistic License 2.0": "artistic-2.0",
        "BSL-1.0": "bsl-1.0",
        "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
        "under Apache-2.0 OR MIT": "apache-2.0,mit",
        "SPDX-License-Identifier: (MIT AND Zlib) OR GPL-2.0-or-later WITH nothing": "gpl-2,mit,zlib",
        "it is NOT released under the MIT license": "",
        "MIT and ISC are names": "",
    }
    noise = [(1000 + i, "some other words of the corpus " * (i % 9), "en", "s") for i in range(200)]
    got = {r.doc_id: r.labels for r in licenses.op5(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + noise)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_labels_against_brute_force(spark):
    """Labels and scores are those of trying each template at every place."""
    rng = random.Random(2)
    chosen = [t for t in licenses.templates() if not t.base]
    rows = []
    for i in range(320):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(i % 3):
            put = [w.decode() for w in rng.choice(chosen).words]
            for _ in range(rng.randrange(4)):  # edited: words lost, put in or moved
                at = rng.randrange(len(put))
                put[at : at + rng.randrange(2)] = rng.choice([[], ["new"], ["not"], ["or", "mit"], put[at : at + 1] * 2])
                put = put or ["x"]
            at = rng.randrange(len(words))
            words[at:at] = put
        rows.append((i, " ".join(words), "en", "s"))
    df = docs(spark, rows)
    index = licenses.Index(*licenses.frequencies(df))
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), r.score) for r in licenses.op5(df).collect()}
    found = 0
    for i, text, _, _ in rows:
        words = licenses.words_of(text.encode())
        labels, score = set(filter(None, brute(text)[4].split(","))), 1.0 if brute(text)[1] else 0.0
        more, best = licenses.outermost([index.fits(k, words, start) for k, t in enumerate(index.templates) if not t.base for start in range(-len(t.words), len(words))])
        labels, score = labels | more, max(score, best)
        assert (labels, round(min(score, 1), 9)) == (got[i][0], round(got[i][1], 9)), text
        found += bool(labels)
    assert found > 100
