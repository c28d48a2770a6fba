"""Problems 6 to 10: brute force, round trips, held-out accuracy, nulls, empty and long texts."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ramagem.llm import abuse, packing, pii, reading, tokens

SF = "/root/testdata/sf0.01"


# 6 ---------------------------------------------------------------------------------------------------------------


def unit_vectors(rng, n, vocabulary=300):
    seg, term = [], []
    for i in range(n):
        t = np.unique(rng.zipf(1.3, size=rng.integers(1, 15)) % vocabulary * 997)
        seg += [i] * len(t)
        term += list(t)
    seg, term = np.array(seg, np.int64), np.array(term, np.int64)
    w = rng.random(len(seg)) + 0.05
    return seg, term, w / np.sqrt(np.bincount(seg, w * w, minlength=n))[seg]


@pytest.mark.parametrize("docs", [0, 1, 5, 300, 2000])
def test_nearest_is_exact(docs):
    rng = np.random.default_rng(docs)
    ds, dt, dw = unit_vectors(rng, docs) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    qs, qt, qw = unit_vectors(rng, 40)
    index = abuse.BlockMaxIndex(ds, dt, dw, docs)
    d, q = np.zeros((docs, 300 * 997)), np.zeros((40, 300 * 997))
    d[ds, dt], q[qs, qt] = dw, qw
    cosines = q @ d.T
    for k, least in ((1, 0.3), (9, 0.3), (4, 0.6)):
        found = index.nearest(qs, qt, qw, 40, k, np.full(40, least))
        want = sorted(
            (i, round(float(c), 9)) for i in range(40) for c in sorted(cosines[i][cosines[i] >= least], reverse=True)[:k]
        )
        assert sorted((int(i), round(float(c), 9)) for i, _, c in zip(*found)) == want
        assert all(abs(cosines[i, j] - c) < 1e-9 for i, j, c in zip(*found))


def test_disguises_are_undone():
    plain = abuse.segments("que idiota")
    for body in ("QUE IDIOTA", "que idiooooota", "que i d i o t a", "que i-d-i-o-t-a", "que 1d10t4", "que id​iota", "que 1d10ta", "que іdiota"):
        assert abuse.segments(body) == plain, body
    for body in (None, "", "   ", "[deleted]", "[AutoModerator]", "...!!!"):
        assert abuse.segments(body) == []
    assert len(abuse.segments("ab cd ef gh " * 5000)) > 1000
    assert abuse.segments("v-e-r-m-e e ponto. a e i o") == [("verme", "e", "ponto"), ("aeio",)]
    assert abuse.segments("que lixo & cia\x1e; https://a.example/x?y=1 oi - tchau") == [("que", "lixo", "cia"), ("oi",), ("tchau",)]


def labelled():
    con = duckdb.connect()
    bare = "regexp_replace(id, '^.*_', '')"
    bodies = dict(con.execute(f"select {bare}, min(body) from '/root/testdata/sf0.1/comments.parquet' where body is not null group by 1").fetchall())
    marks = con.execute(f"select {bare}, avg(case when content_flag <> 'none' then 1.0 else 0 end) from '/root/testdata/sf0.1/message_annotation.parquet' where content_flag is not null group by 1").fetchall()
    return sorted((i, bodies[i], float(y)) for i, y in marks if i in bodies)


def counted(bodies):
    table = np.zeros(abuse.TERM_SPACE, np.int64)
    abuse.frequencies(abuse.Reader(), bodies, table)
    return table


def test_held_out_comments():
    every = labelled()
    frequency = counted([b for _, b, _ in every])
    texts = {str(abuse.segments(b)) for _, b, _ in every}
    part = {t: i % 4 == 0 for i, t in enumerate(sorted(texts))}  # copies stay on one side
    train = [x for x in every if not part[str(abuse.segments(x[1]))]]
    test = [x for x in every if part[str(abuse.segments(x[1]))]]
    model = abuse.fit(train, frequency, len(every))
    vote, *_ = abuse.Scorer(model).bodies([b for _, b, _ in test])
    truth, said = np.array([y > 0.5 for *_, y in test]), model.probability(vote) >= abuse.THRESHOLD
    # about 5 % of the flags are wrong, on either side
    assert (said & truth).sum() / said.sum() > 0.88 and (said & truth).sum() / truth.sum() > 0.78
    # leaving out what can't reach the bar changes no vote beyond it
    quick, *_ = abuse.Scorer(model, model.even).bodies([b for _, b, _ in test])
    assert np.array_equal(np.where(vote >= model.even, vote, 0), np.where(quick >= model.even, quick, 0))


def test_votes_equal_brute_force():
    every = labelled()[:1500]
    model = abuse.fit(every, counted([b for _, b, _ in every]), len(every))
    bodies = [b for _, b, _ in labelled()[1500:1800]]
    read = abuse.Reader().read(bodies)
    first, last = read.segments()
    vote, _ = model.raw(read, first, last)
    seg, term, w = model.weights(read, first, last)
    q = np.zeros((len(first), model.every.terms + 1))
    q[seg, term] = w
    for i, row in enumerate(q):
        cosine = (model.every.doc_weights * row[model.every.doc_terms]).sum(1)
        near = np.lexsort((np.arange(len(cosine)), -cosine))[: abuse.NEIGHBOURS]
        near = near[cosine[near] >= abuse.LEAST_COSINE]
        weight = cosine[near] ** abuse.VOTE_POWER * np.sqrt(model.m[near])
        assert vote[i] == pytest.approx((weight * model.y[near]).sum() / (weight.sum() + abuse.CLEAN_VOTE), abs=1e-9)


def test_calibration_sees_through_wrong_labels_and_the_sample():
    rng = np.random.default_rng(5)
    true = rng.random(4000) < 0.5
    vote = np.clip(np.where(true, 0.85, 0.15) + rng.normal(0, 0.12, 4000), 0, 1)
    wrong = rng.random(4000) < 0.05
    slope, offset, sure = abuse.calibrate(vote, (true ^ wrong).astype(float))
    assert np.mean((sure > 0.5) == true) > 0.99 and 0.4 < -offset / slope < 0.6
    model = abuse.fit([("a", "seu idiota imundo", 1.0), ("b", "bom dia a todos", 0.0)], counted(["seu idiota imundo", "bom dia a todos"]), 2)
    model.base, model.hits, model.false = 0.5, 0.96, 0.02
    assert model.rate(0.02 + 0.94 * 0.1) == pytest.approx(0.1) and model.rate(0.0) == 1e-5 and model.rate(1.0) == 0.5
    assert model.probability(np.array([0.6]), 0.1) < model.probability(np.array([0.6]))


def test_segments_vote_down_to_the_least_cosine():
    labels = [("a", "seu idiota imundo some daqui", 1.0), ("b", "bom dia a todos", 0.0)]
    model = abuse.fit(labels, np.zeros(abuse.TERM_SPACE, np.int64), 100)
    read = abuse.Reader().read(["idiota imundo meu carro", "some gente nova"])
    first, last = read.segments()
    q, _, cosine = model.flagged.nearest(*model.weights(read, first, last), 2, 1, np.full(2, 0.01))
    assert list(q) == [0, 1] and abuse.LEAST_COSINE <= cosine[0] < 0.5 and cosine[1] < abuse.LEAST_COSINE
    vote, near = model.raw(read, first, last)
    assert vote[0] > 0 and near[0] == 0 and vote[1] == 0 and near[1] == -1


def test_bounds_on_labelled_comments(spark):
    comments = spark.range(14_000).selectExpr("string(id) id", "concat('texto ', id) body")
    marks = comments.selectExpr("id", "if(int(id) % 2 = 0, 'abuse', 'none') content_flag")
    taken = abuse.labelled_bodies(comments, marks)
    assert Counter(y for *_, y in taken) == {1.0: 6000, 0.0: 6000}
    assert Counter(y for *_, y in abuse.labelled_bodies(comments.where("int(id) < 11000"), marks.where("int(id) < 11000"))) == {1.0: 5500, 0.0: 5500}


def test_abuse_frames(spark):
    comments = spark.createDataFrame([("a", "seu idiota", 1), ("b", "bom dia a todos", 1), ("c", None, 1), ("d", "", 1), ("e", "seu idiota", 2), ("f", "seu idiota mesmo", 3)], "id string, body string, score long")
    marks = spark.createDataFrame([("a", "abuse"), ("a", "abuse"), ("b", "none"), ("c", "hate"), ("x", None)], "id string, content_flag string")
    model = abuse.learn(comments, marks)
    got = {r["id"]: (r["score"], r["example"]) for r in abuse.scored(comments, model).collect()}
    assert got["e"][0] >= 0.5 and got["e"][1] == "a" and got["c"] == (0.0, None) and got["d"] == (0.0, None) and got["b"][0] < 0.5
    assert abuse.learn(comments, marks.limit(0)) is None
    assert [r["score"] for r in abuse.scored(comments, None).collect()] == [0.0] * 6
    assert abuse.learn(comments.limit(0), marks) is None


# 7 ---------------------------------------------------------------------------------------------------------------

HITS = [
    ("me escreve em zilda.caldel+lista@correio.example.net ok", "email", "zilda.caldel+lista@correio.example.net"),
    ("contato: ana_b arroba cartas ponto invalid", "email", "ana_b arroba cartas ponto invalid"),
    ("b.x [at] caixa [dot] example [dot] org", "email", "b.x [at] caixa [dot] example [dot] org"),
    ("chama no zap 70951137875", "phone", "70951137875"),
    ("(90) 90064‑1866 (recado)", "phone", "(90) 90064‑1866"),
    ("call 210.555.0142 now", "phone", "210.555.0142"),
    ("pediram o documento e passei CPF 50093962581", "id_number", "50093962581"),
    ("vazaram meu 029.822.620-52.", "id_number", "029.822.620-52"),
    ("filtraron mi DNI 36301313S", "id_number", "36301313S"),
    ("the form shows SSN 666-21-2546", "id_number", "666-21-2546"),
    ("cadastro em nome de passaporte QX626876 hoje", "id_number", "QX626876"),
    ("moro na Rua das Flores, 12", "address", "Rua das Flores, 12"),
    ("I live at 489 Old Mill Drive, Apt 22.", "address", "489 Old Mill Drive, Apt 22"),
    ("vivo en C/ de los Talleres, 2609, piso 4", "address", "C/ de los Talleres, 2609, piso 4"),
    ("meu nome é JOÃO TREVOVOL", "name", "JOÃO TREVOVOL"),
    ("o síndico edu ostricaque não responde", "name", "edu ostricaque"),
    ("att, Peltresciva, Antônia", "name", "Peltresciva, Antônia"),
    ("o gerente Caio T. Bravadol me ligou", "name", "Caio T. Bravadol"),
    ("Marta Ribalves de Souzela owes me money", "name", "Marta Ribalves de Souzela"),
    ("what a team. I spoke with Helena Norvaz", "name", "Helena Norvaz"),
    ("my name is Oskaru Lindqvarn", "name", "Oskaru Lindqvarn"),
    ("o documento: 88.848.833-R", "id_number", "88.848.833-R"),
    ("I lost my ticket. Text 217.555.0112", "phone", "217.555.0112"),
    # check digits that hold decide without a word
    ("e 52998224725 fim", "id_number", "52998224725"),
    ("só 45.723.174/0001-10 mesmo", "id_number", "45.723.174/0001-10"),
    ("12345678Z", "id_number", "12345678Z"),
    ("4539 5787 6362 1486", "payment", "4539 5787 6362 1486"),
    ("manda pra GB82 WEST 1234 5698 7654 32", "payment", "GB82 WEST 1234 5698 7654 32"),
    # and block what would else be read as a phone number
    ("liga: 4539 5787 6362 1486", "payment", "4539 5787 6362 1486"),
]
MISSES = [
    None, "", "  ", "pedido 14584304645 ainda não chegou", "protocolo 6719-875-099", "fones modelo 40-82776-9870 em falta", "recorde de 681.845.188 pontos", "ISBN 978-0-0404-2690-1",
    "código de rastreio QX482403098ZZ", "levei 9@17.03 cada", "segue lá @trevimez_80", "u/zambovol196 já respondeu", "encontro na Rua Estrela Guia às 16h", "a linha 53 da Avenida Vereda Alta",
    "a personagem Ana Rita Lua Torta do jogo", "4539 5787 6362 1487", "e 52998224726 fim", "na escola Maria Souzela hoje", "EL VECINO ENCONTRÓ LA CONSOLA", "placar 9x6, público 61376", "comprei por R$ 1480 na feira de rua", "instalei o pacote-rota@3.9.0",
]


@pytest.mark.parametrize("text, kind, span", HITS)
def test_personal_information(text, kind, span):
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)] == [(kind, span)]
    assert pii.redact(text) == text.replace(span, pii.PLACEHOLDER[kind])


@pytest.mark.parametrize("text", MISSES)
def test_no_personal_information(text):
    assert pii.find_spans(text) == [] and pii.redact(text) == text


@pytest.mark.parametrize("street", ["R.Augusta, 120", "Rua\tAugusta, 120", "Rua\nAugusta, 120"])
def test_street_hints_hold_all_that_the_pattern_takes(street):
    assert pii.STREET.search(street)
    assert [s.kind for s in pii.find_spans(f"fica na {street}")] == ["address"]


def test_checksums():
    assert pii.luhn_holds("4539578763621486") and not pii.luhn_holds("4539578763621487")
    assert pii.mod97_holds("GB82 WEST 1234 5698 7654 32") and not pii.mod97_holds("GB82 WEST 1234 5698 7654 33")
    assert pii.weighted_mod11_holds("52998224725") and not pii.weighted_mod11_holds("52998224726") and not pii.weighted_mod11_holds("11111111111")
    assert pii.letter23_holds("12345678Z") and not pii.letter23_holds("12345678A")


def test_redaction_frames(spark):
    texts = spark.createDataFrame([("comment", "1", "tel 90 96854 2532 e x@y.example"), ("comment", "1", "tel 90 96854 2532"), ("comment", "2", None), ("post_header", "1", "x@y.example " * 2000)], "record string, id string, text string")
    assert sorted(map(tuple, pii.kinds_found(texts).collect())) == [("comment", "1", "email"), ("comment", "1", "phone"), ("post_header", "1", "email")]
    out = {(r["record"], r["id"], r["n_spans"]): r["text"] for r in pii.redacted(texts).collect()}
    assert out["comment", "1", 2] == "tel [PHONE] e [EMAIL]" and out["comment", "2", 0] is None and out["post_header", "1", 2000] == "[EMAIL] " * 2000
    assert pii.kinds_found(texts.limit(0)).collect() == []


# 8 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens.load_vocabulary().tokens)}, special_tokens={})


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_encoding_is_exact_on_any_text(vocabulary, library, text):
    assert vocabulary.encode(text) == library.encode_ordinary(text)
    assert vocabulary.decode(vocabulary.encode(text)) == text


def test_encoding_of_documents_and_long_runs(vocabulary, library):
    texts = [r[0] for r in duckdb.connect().execute(f"select text from '{SF}/documents.parquet' where text is not null").fetchall()]
    for text in [*texts, "a" * 30_000, "abcab" * 5_000, "=" * 9_999, "<|endoftext|>"]:
        assert vocabulary.encode(text) == library.encode_ordinary(text)
    assert vocabulary.encode(None) == vocabulary.encode("") == []


def test_vocabulary_files_agree(tmp_path, vocabulary):
    os.symlink(os.path.join(tokens.TOKENIZER_FOLDER, "byte_bpe_50k.json"), tmp_path / "byte_bpe_50k.json")
    assert tokens.load_vocabulary("byte_bpe_50k", str(tmp_path)).tokens == vocabulary.tokens


def test_encoding_frames(spark, vocabulary):
    df = spark.createDataFrame([(1, "olá mundo", "x"), (2, None, "y"), (3, "", "z"), (1, "olá mundo", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encoded(df).collect())
    assert got == [(1, vocabulary.encode("olá mundo"))] * 2 + [(2, []), (3, [])]
    assert sorted(r["text"] for r in tokens.decoded(tokens.encoded(df)).collect()) == ["", "", "olá mundo", "olá mundo"]


# 9 ---------------------------------------------------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=20), st.integers(30, 50))
@settings(max_examples=150, deadline=None)
def test_recipes_use_everything_once(histogram, capacity):
    left = Counter(histogram)
    for r in packing.plan_recipes(histogram, capacity):
        assert sum(r.lengths) <= capacity and r.times > 0
        for p in r.lengths:
            left[p] -= r.times
    assert not any(left.values())


def test_packing_frames(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([0, 7, 7, 7, None, *range(1, 130)])) for i in range(3000)] + [(9_999, 350), (9_999, 350)]
    items = spark.createDataFrame(data, "doc_id long, n_tokens long").repartition(5).withColumn("length", packing.F.lit(1))
    got = packing.pack(items, 100).collect()
    used = Counter()
    for r in got:
        used[r["container"]] += r["n_tokens"]
    assert max(used.values()) <= 100
    want = Counter()
    for i, n in data:
        n = n or 0
        for k in range(max(1, -(-n // 100))):
            want[i, k, min(100, n - 100 * k)] += 1
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == want
    total = sum(n or 0 for _, n in data)
    assert len(used) <= -(-total // 100) + 2  # hardly any room left over
    assert packing.pack(items.limit(0), 100).collect() == []
    assert {r["container"] for r in packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long"), 100).collect()} == {0}


# 10 --------------------------------------------------------------------------------------------------------------


def test_levels_of_held_out_documents():
    con = duckdb.connect()
    docs = con.execute("select doc_id, text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall()
    grades: dict[int, list[int]] = {}
    for d, band in con.execute("select doc_id, band from '/root/testdata/sf0.1/reading_label.parquet'").fetchall():
        grades.setdefault(d, []).append(band)
    counters = np.bincount(reading.Reader().read([t for _, t in docs])["counter"], minlength=reading.WORD_COUNTERS)
    graded = [(d, t) for d, t in docs if d in grades]
    at, x = reading.FeatureMaker(counters).rows([t for _, t in graded])
    y = np.array([np.mean(grades[graded[i][0]]) for i in at])
    test = np.array([zlib.crc32(graded[i][1].encode()) % 4 == 0 for i in at])
    above = reading.fit_ordinal(x[~test], y[~test]).above(x[test])
    assert (np.diff(above, axis=1) <= 1e-12).all()  # harder bands are never likelier to be passed
    said, truth = above[:, 2] >= 0.5, y[test] >= 3.5
    assert (said & truth).sum() / said.sum() > 0.88 and (said & truth).sum() / truth.sum() > 0.85
    assert np.abs(1 + above.sum(1) - y[test]).mean() < 0.4


def test_reading_features_by_hand():
    text = "Sin embargo, o gato caiu. Eu vi o gato; que bom: " + "x" * 30
    texts = [None, "", "12 ...", text, text + "\x1e", "gato " * 120]
    counters = np.bincount(reading.Reader().read(texts)["counter"], minlength=reading.WORD_COUNTERS)
    at, x = reading.FeatureMaker(counters).rows(texts)
    assert at.tolist() == [3, 4, 5] and np.allclose(x[0], x[1])
    f = dict(zip(reading.FEATURES, x[0]))
    words = "sin embargo o gato caiu eu vi o gato que bom".split()
    lengths = np.array([len(w) for w in words])
    assert f["log_words"] == pytest.approx(np.log1p(12)) and f["word_length"] == pytest.approx(lengths.mean()) and f["word_length_sd"] == pytest.approx(lengths.std())
    assert f["connectives"] == pytest.approx(1 / 12) and f["subordinators"] == pytest.approx(1 / 12) and f["runs"] == pytest.approx(1 / 12) and f["commas"] == pytest.approx(3 / 12)
    assert f["sentence_length"] == pytest.approx(np.log1p(6)) and f["sentence_length_max"] == pytest.approx(np.log1p(7)) and f["diversity"] == pytest.approx(10 / 12)
    assert dict(zip(reading.FEATURES, x[2]))["diversity"] == pytest.approx((1 / 50 + 1 / 50) / 2)  # the last 20 words are too few
    one = reading.FeatureMaker(counters).rows(texts[3:4])[1]
    assert np.allclose(one[0], x[0])
    surprise = np.array([reading.FeatureMaker(counters).surprise[reading.counter_of(w)] for w in words] + [0.0])
    assert f["rarity_high"] == pytest.approx(np.quantile(surprise, 0.75))


def test_reading_frames(spark):
    easy, hard = "o gato caiu. eu vi o gato.", "a indeterminação proposicional consubstancia, conquanto residualmente, a inteligibilidade macroestrutural"
    data = [(i, (easy if i % 2 else hard) + f" {'abcdefgh'[i % 8] * 2}", "s") for i in range(40)] + [(100, None, "s"), (101, "", "s"), (102, " \n", "s"), (103, "1234 ...", "s"), (104, "x" * 50_000, "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, "r", 1 if i % 2 else 5) for i in range(20)] + [(100, "r", 3), (0, "q", 4), (1, "q", None)], "doc_id long, rater string, band int")
    model, counters = reading.fit(docs, marks)
    got = {r["doc_id"]: r for r in reading.score(docs, model, counters, ("source",)).collect()}
    assert len(got) == len(data) and all(got[i]["band"] is None and got[i]["p_hard"] is None for i in (100, 101, 102, 103)) and got[104]["band"] is not None
    assert all((got[i]["p_hard"] >= 0.5) == (i % 2 == 0) for i in range(40))
    none, counters = reading.fit(docs, marks.limit(0))
    assert none is None and all(r["band"] is None for r in reading.score(docs, none, counters).collect())
