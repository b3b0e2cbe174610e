from __future__ import annotations

import re

from sluicework.llm import licenses as L


def plain(text):
    text = re.sub(r"[^A-Za-z0-9\n]+", " ", text or "").lower().replace("licence", "license")
    units, found = set(text.split("\n")) | set(re.split(r"\n[ \n]*\n", text)) | {text}, []
    for unit in units:
        words = unit.split()
        grams = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        for name, held in L.template_bigrams(L.TEMPLATES).items():
            score = 2 * len(grams & set(held)) / (len(grams) + len(held))
            if score >= L.LEAST:
                found.append((score, name))
    return found


def test_equals_plain(docs_of, small_docs):
    texts = [None, "", "\n", "All rights reserved.", "all RIGHTS\treserved", "Released under the MIT Licence!", "x\nLicensed under the Apache License, Version 2.0.\ny", "This work is licensed under the GNU General Public License, version 2."]
    texts += list(L.TEMPLATES.values()) + ["\n\n".join(L.TEMPLATES.values()), L.TEMPLATES["MIT-text"].replace(", ", ",\n"), "word " * 20000, "Released under the MIT License.\n" * 50]
    texts += [r.text for r in small_docs.collect()]
    got = {r.doc_id: r for r in L.scan(docs_of(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        found = plain(text)
        top = max((s for s, _ in found), default=None)
        assert got[i].n_matches == len(found), text and text[:80]
        assert got[i].license == min((n for s, n in found if s == top), default=None)
        assert got[i].score == (None if top is None else round(top, 6))
        assert got[i].licenses == ",".join(sorted({n for _, n in found}))


def test_every_template_finds_itself(docs_of):
    names = sorted(L.TEMPLATES)
    got = {r.doc_id: r.license for r in L.scan(docs_of([(i, L.TEMPLATES[n]) for i, n in enumerate(names)])).collect()}
    assert [got[i] for i in range(len(names))] == names


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    got = L.scan(docs_of([(1, "All rights reserved."), (1, "All rights reserved."), (None, None)])).collect()
    assert sorted(str(r.license) for r in got) == ["All-Rights-Reserved", "All-Rights-Reserved", "None"]
    assert L.scan(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = L.scan(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_no_match_goes_without_a_cue_word():
    held = L.template_bigrams(L.TEMPLATES)
    cues = set(L.cue_words(held, L.LEAST))
    for grams in held.values():
        bare = [g for g in grams if not cues.intersection(g.split())]
        assert len(bare) < len(grams) * L.LEAST / (2 - L.LEAST)
    assert not cues & {"the", "under", "all", "of", "and"}
