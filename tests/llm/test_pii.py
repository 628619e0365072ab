import math
import random
import re
from collections import defaultdict

from helpers import DOCS, docs_of, odd_texts, with_clashing_columns, words

from logarbor.llm import pii
from logarbor.llm.queries import QUERIES

TEXTS = [
    "mail a.b+c@x-1.example.com, and bad@nodot or @x.y or a@b..c or x@y.z@w.v",
    "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3 9.9.9.9999 1..2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005, 12",
    "call +1 (743) 555-3824 or +12 or +49.30.123456789 or ++1 555 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "x" * 300 + "@" + "y" * 300, "1" * 3000, "1." * 500, "a.b@" * 200, "+" * 100 + "1" * 40, "é🙂 me@é.com me@a.b🙂",
]


def reference_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.findall("[0-9]", m.group())]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab1.2@-+ ()0é") for _ in range(80)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == reference_spans(t), t


def reference_added(texts, window=5, support=3, generalise_at=0.8, remove_at=0.95):
    """Brute force: spans added for each text."""
    term = re.compile(r"[^\W\d_]{3,}")
    near = []  # (entity, term, start, end) for each text
    for t in texts:
        spans, own = reference_spans(t or ""), []
        for s, k, e in spans:
            ws = [m.span() for m in term.finditer(t or "")]
            # the search is made on each side of the entity alone
            before = [m.span() for m in term.finditer((t or "")[:s])][-window:]
            after = [(m.start() + e, m.end() + e) for m in term.finditer((t or "")[e:])][:window]
            value = (k, t[s:e].lower() if k < 2 else "".join(re.findall("[0-9]", t[s:e])))
            own += [(value, t[a:b].lower(), a, b) for a, b in before + after
                    if not any(a < y and x < b for x, _, y in spans)]
            del ws
        near.append(own)
    n = len(texts)
    df_t, df_e, co = defaultdict(int), defaultdict(int), defaultdict(int)
    for t, own in zip(texts, near):
        for w in {w.lower() for w in term.findall(t or "")}:
            df_t[w] += 1
        for e in {c[0] for c in own}:
            df_e[e] += 1
        for pair in {c[:2] for c in own}:
            co[pair] += 1
    out = []
    for own in near:
        added = {}
        for e, w, a, b in own:
            if co[e, w] >= support and df_e[e] < n:
                share = math.log2(co[e, w] * n / (df_e[e] * df_t[w])) / math.log2(n / df_e[e])
                if share >= generalise_at:
                    added[a, b] = max(added.get((a, b), 0), 5 if share >= remove_at else 4)
        out.append(sorted((a, k, b) for (a, b), k in added.items()))
    return out


def corpus():
    rng = random.Random(8)
    texts = odd_texts() + TEXTS
    for i in range(40):
        texts.append(f"the agent {words(rng, 4)} codename zephyr writes to spy@hq.example.org about the plan {words(rng, 5)}")
    for i in range(25):  # a term that mostly, not only, stands with its entity
        texts.append(f"dial falcon now +1 (743) 555-3824 {words(rng, 8)}" if i % 6 else f"the falcon flew {words(rng, 8)}")
    texts += ["the plan of the agent is the agent"] * 60
    return texts


def test_spans_equal_brute_force(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in pii.find_spans(docs_of(spark, texts)).collect()}
    added = reference_added(texts)
    assert len(rows) == len(texts)
    kinds = set()
    for i, t in enumerate(texts):
        base = reference_spans(t or "")
        assert [tuple(s) for s in rows[i].base] == base
        assert [tuple(s) for s in rows[i].spans] == sorted(base + added[i])
        kinds |= {k for _, k, _ in added[i]}
    assert kinds == {4, 5}


def test_sanitised_texts(spark):
    texts = corpus()
    docs = with_clashing_columns(docs_of(spark, texts))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, (t, extra) in enumerate(zip(texts, reference_added(texts))):
        want = None if t is None else pii.apply_spans(t, reference_spans(t) + extra)
        assert got[i].text == want
        assert got[i].n_chars == (None if t is None else len(want))
        assert got[i].row_key_0 == "clash"
    joined = " ".join(r.text or "" for r in got.values())
    assert "zephyr" not in joined and "spy@" not in joined and "the plan" in joined


def test_overlapping_spans_and_empty_tables(spark):
    assert pii.apply_spans("abcdef", [(1, 0, 4), (2, 1, 5)]) == "a[EMAIL]f"
    empty = spark.createDataFrame([], DOCS)
    assert pii.find_spans(empty).count() == 0
    assert pii.sanitise(empty).count() == 0
    same = spark.createDataFrame([(None, "me@a.bc", None, None, 7)] * 2 + [(None, None, None, None, None)], DOCS)
    assert sorted((r.text or "") for r in pii.sanitise(same).collect()) == ["", "[EMAIL]", "[EMAIL]"]


def test_query_marks_terms_of_entities_in_one_and_two_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [f"{words(rng, 30)} zephyr writes to spy@hq.example.org today", f"{words(rng, 30)} falcon calls me@one.example.org",
             f"{words(rng, 30)} falcon calls me@one.example.org"] + [words(rng, 40) + " writes calls today" for _ in range(60)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in QUERIES["op8_pii_disclosure"](spark, str(tmp_path)).collect()}
    for i, word in ((0, "zephyr"), (1, "falcon"), (2, "falcon")):
        at = texts[i].index(word)
        assert f"removed:{at}:{at + len(word)}" in got[i].split(",")
    assert all(got[i] == "" for i in range(3, len(texts)))


def whole_document_added(texts, support=1, generalise_at=0.8, remove_at=0.95):
    """Brute force with the whole document as the context: spans added for each text."""
    term = re.compile(r"[^\W\d_]{3,}")
    n, df_t, df_e, co, held = len(texts), defaultdict(int), defaultdict(int), defaultdict(int), []
    for t in texts:
        t = t or ""
        spans = reference_spans(t)
        own = {(k, t[s:e].lower() if k < 2 else "".join(re.findall("[0-9]", t[s:e]))) for s, k, e in spans}
        free = [(m.group().lower(), *m.span()) for m in term.finditer(t)
                if not any(m.start() < e and s < m.end() for s, _, e in spans)]
        held.append((own, free))
        for w in {w.lower() for w in term.findall(t)}:
            df_t[w] += 1
        for e in own:
            df_e[e] += 1
            for w in {w for w, _, _ in free}:
                co[e, w] += 1
    out = []
    for own, free in held:
        added = {}
        for e in own:
            for w, a, b in free:
                if co[e, w] >= support and df_e[e] < n:
                    share = math.log2(co[e, w] * n / (df_e[e] * df_t[w])) / math.log2(n / df_e[e])
                    if share >= generalise_at:
                        added[a, b] = max(added.get((a, b), 0), 5 if share >= remove_at else 4)
        out.append(sorted((a, k, b) for (a, b), k in added.items()))
    return out


def near_evidence_added(texts, window=5, support=1, generalise_at=0.8, remove_at=0.95):
    """Brute force with evidence near an entity and marks in every document that holds it."""
    term = re.compile(r"[^\W\d_]{3,}")
    n, df_t, df_e, co, held = len(texts), defaultdict(int), defaultdict(int), defaultdict(int), []
    for t in texts:
        t = t or ""
        spans = reference_spans(t)
        free = [m for m in term.finditer(t) if not any(m.start() < e and s < m.end() for s, _, e in spans)]
        everything = list(term.finditer(t))
        own, met = set(), set()
        for s, k, e in spans:
            name = (k, t[s:e].lower() if k < 2 else "".join(re.findall("[0-9]", t[s:e])))
            own.add(name)
            before = [m for m in term.finditer(t[:s])][-window:]
            near = {(m.start(), m.end()) for m in before} | {(m.start() + e, m.end() + e) for m in list(term.finditer(t[e:]))[:window]}
            met |= {(name, m.group().lower()) for m in free if m.span() in near}
        held.append((own, free))
        for w in {m.group().lower() for m in everything}:
            df_t[w] += 1
        for e in own:
            df_e[e] += 1
        for pair in met:
            co[pair] += 1
    kinds = {}
    for (e, w), c in co.items():
        if c >= support and df_e[e] < n:
            share = math.log2(c * n / (df_e[e] * df_t[w])) / math.log2(n / df_e[e])
            if share >= generalise_at:
                kinds[e, w] = 5 if share >= remove_at else 4
    out = []
    for own, free in held:
        added = [(m.start(), max((kinds.get((e, m.group().lower()), 0) for e in own), default=0), m.end()) for m in free]
        out.append(sorted(a for a in added if a[1]))
    return out


def test_near_evidence_marked_everywhere_equals_brute_force(spark):
    rng = random.Random(13)
    texts = corpus()
    texts += [f"{words(rng, 50)} zephyr {words(rng, 20)} near spy@hq.example.org", "a@b.example " * 2 + "quartz then quartz",
              " ".join(f"user{i}@many.example" for i in range(100)) + " crowd"]
    added = near_evidence_added(texts)
    got = {r.doc_id: r.spans for r in pii.find_spans(docs_of(spark, texts), everywhere=True, support=1).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]] == sorted(reference_spans(t or "") + added[i])
    assert {k for a in added for _, k, _ in a} == {4, 5}
    docs = with_clashing_columns(docs_of(spark, texts))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, everywhere=True, support=1).collect()}
    for i, t in enumerate(texts):
        assert clean[i] == (None if t is None else pii.apply_spans(t, reference_spans(t) + added[i]))


def test_words_frequent_beside_entities_are_not_counted(spark, monkeypatch):
    """A word near one entity alone, but in most documents that hold one, cannot pass and is no candidate."""
    usual = " ".join(f"usual{chr(97 + i)}" for i in range(20))
    texts = [f"person{i}@corp.example kestrel{chr(97 + i)} usual{chr(97 + i)} stand here with other words {usual}" for i in range(20)]
    texts += [usual] * 40 + ["quite plain"] * 40
    counted, count = set(), pii.term_frequencies
    monkeypatch.setattr(pii, "term_frequencies",
                        lambda docs, terms: counted.update(r.term for r in terms.collect()) or count(docs, terms))
    got = {r.doc_id: r.spans for r in pii.find_spans(docs_of(spark, texts), everywhere=True, support=1).collect()}
    assert counted == {f"kestrel{chr(97 + i)}" for i in range(20)}
    for i, (t, added) in enumerate(zip(texts, near_evidence_added(texts))):
        assert [tuple(s) for s in got[i]] == sorted(reference_spans(t) + added)


def test_rare_words_far_from_an_entity_stay(spark):
    rng = random.Random(17)
    common = "their usual words stand here and fill the letter with plain project mail soon".split()
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    usual = [filler(60) for _ in range(200)]
    rare = [" ".join(f"rare{chr(97 + i)}{chr(97 + k)}q" for k in range(20)) for i in range(20)]
    texts = [f"{rare[i]} {filler(12)} project kestrel{chr(97 + i)} mail person{i}@corp.example soon {filler(12)}" for i in range(20)]
    spans = pii.find_spans(docs_of(spark, texts + usual), everywhere=True, support=1).collect()
    for r in spans:
        if r.doc_id < 20:
            marked = {texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind >= pii.BASE_KINDS}
            assert f"kestrel{chr(97 + r.doc_id)}" in marked and not any(w.startswith("rare") for w in marked)


def test_whole_documents_equal_brute_force(spark):
    texts = corpus()
    texts.append("first@a.example and second@a.example stand in one text with the plan")
    texts.append(" ".join(f"user{i}@many.example" for i in range(200)) + " crowd")
    added = whole_document_added(texts)
    got = {r.doc_id: r.spans for r in pii.find_spans(docs_of(spark, texts), window=None, support=1).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]] == sorted(reference_spans(t or "") + added[i])
    assert {k for a in added for _, k, _ in a} == {4, 5}


def test_far_mentions_of_a_revealing_term_are_marked(spark, tmp_path):
    far = "zephyr writes to spy@hq.example.org " + "and then some more of the usual words " * 5 + "says Zephyr"
    texts = [far] + ["and then some more of the usual words writes says"] * 60
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in QUERIES["op8_pii_disclosure"](spark, str(tmp_path)).collect()}
    assert {"removed:0:6", f"removed:{len(far) - 6}:{len(far)}"} <= set(got[0].split(","))
    (clean, *_) = [r.text for r in pii.sanitise(docs_of(spark, texts), window=None, support=1).orderBy("doc_id").collect()]
    assert "zephyr" not in clean.lower() and "usual" in clean
