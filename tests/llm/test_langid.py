import numpy as np

from loomline.llm import langid as L

WORDS = {"en": "the house and with from that this have were which", "de": "der und nicht mit von über straße können werden auch", "fr": "le la et dans une être avec pour où très"}


def corpus(spark, n=40):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(w.split(), 30)), lang, "s") for lang, w in WORDS.items() for i in range(n)]
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = L.train(docs.where(~L.held_out(docs.doc_id)))
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    held = docs.where(L.held_out(docs.doc_id)).collect()
    assert len(held) > 10 and all(got[r.doc_id].lang_pred == r.lang and 0 < got[r.doc_id].score <= 1 for r in held)


def test_odd_texts(docs, no_docs, spark):
    model = L.train(corpus(spark))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (4, 5, 6, 10, 13))
    assert got[1][0] == "en" and L.predict(docs, model).count() == docs.count()
    assert L.predict(no_docs, model).count() == 0 and L.train(no_docs) == {}
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"}
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, 9, 11, 12}


def test_profile_is_the_sum_of_bound_letters():
    letters = L.Letters(64)
    code = [0, ord("a"), ord("ж"), 0]
    v = lambda c: letters.vector(c).astype(int)
    want = sum(np.roll(v(x), 2) * np.roll(v(y), 1) * v(z) for x, y, z in zip(code, code[1:], code[2:]))
    vectors, n = L.profiles(["aЖ".encode(), b""], letters)
    assert np.array_equal(vectors[0], want) and n.tolist() == [2, 0] and not vectors[1].any()


def test_cases_and_gaps_agree():
    letters = L.Letters()
    (a, b), _ = L.profiles([b"Some Words", b"sOME  - wORDS!"], letters)
    assert np.array_equal(a, b)


def test_every_letter_has_its_own_vector(monkeypatch):
    letters = L.Letters()
    codes = [*range(0x430, 0x450), *range(0x3B1, 0x3CA), *range(0x4E00, 0x4E80), ord("å"), ord("ý"), ord("þ"), 0x20000, 0]
    v = letters.vectors(np.array(codes)).astype(int)
    assert np.abs(v @ v.T - 1024 * np.eye(len(codes), dtype=int)).max() < 250
    # many n-grams are bound in chunks, and letters that a process has forgotten are drawn again
    text = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(9000)).encode()
    whole = L.profiles([text, b"abc"], letters)[0]
    monkeypatch.setattr(L, "CHUNK", 100)
    monkeypatch.setattr(L, "KEPT", 50)
    assert np.array_equal(L.profiles([text, b"abc"], L.Letters())[0], whole)


def test_languages_of_other_scripts(spark):
    """Languages of one script, by words that each has of its own, as brute-force trigram counts separate them."""
    words = {
        "ru": "это что как был она его все так уже для только когда быть время который", "bg": "това какво като беше тя неговата всички така вече само когато бъде време който са",
        "uk": "це що як був вона його всі так вже для тільки коли бути час який", "el": "είναι και για από που στην αυτό πως ήταν όταν μόνο χρόνος πρέπει", "pl": "jest że się nie był ona jego wszystkie już tylko kiedy być czas który są",
        "cs": "je že se není byl ona jeho všechny už jen když být čas který jsou", "zh": "这 是 的 不 了 在 有 我 他 们 大 来 上 国 个", "ja": "これ は です の が を に で した ます から まで する", "ko": "이것 은 는 그 그녀 모든 이미 때 시간 되다 있다 했다",
    }
    r = np.random.default_rng(3)
    rows = [(lang, " ".join(r.choice(w.split(), 12))) for lang, w in words.items() for _ in range(40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = L.train(docs.where(~L.held_out(docs.doc_id)))
    got = {x.doc_id: x.lang_pred for x in L.predict(docs, model).collect()}
    held = docs.where(L.held_out(docs.doc_id)).collect()
    assert len(held) > 60 and sum(got[x.doc_id] == x.lang for x in held) >= 0.97 * len(held)


def test_predictions_are_those_of_plain_loops(spark):
    """Prototypes and cosines by counting trigrams one at a time."""
    docs = corpus(spark)
    letters, rows = L.Letters(), docs.collect()

    def vector(text):
        points = [0]
        for c in text.lower() + " ":
            if c.isalpha() or points[-1]:
                points.append(ord(c) if c.isalpha() else 0)
        v = [letters.vector(p).astype(float) for p in points]
        return sum(np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:]))

    units = {r.doc_id: (x := vector(r.text)) / np.linalg.norm(x) for r in rows}
    held = {r.doc_id for r in docs.where(L.held_out(docs.doc_id)).collect()}
    sums = {lang: sum(units[r.doc_id] for r in rows if r.lang == lang and r.doc_id not in held) for lang in WORDS}
    cosines = {i: {lang: float(u @ s / np.linalg.norm(s)) for lang, s in sums.items()} for i, u in units.items()}
    for x in L.predict(docs, L.train(docs.where(~L.held_out(docs.doc_id)))).collect():
        want = max(sorted(cosines[x.doc_id]), key=cosines[x.doc_id].get)
        assert x.lang_pred == want and abs(x.score - cosines[x.doc_id][want]) < 1e-5


def test_equal_cosines_go_to_the_first_name(spark):
    same = spark.createDataFrame([(i, "some words", lang) for i, lang in enumerate(["b", "a", "c"])], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict(same, L.train(same)).collect()} == {"a"}


def test_stage_goes_by_the_verdict(docs, spark):
    lettered = {1, 2, 3, 7, 8, 9, 11, 12}
    assert {r.doc_id for r in L.keep_known(docs, {}).collect()} == lettered
    model = L.train(corpus(spark))
    score = {r.doc_id: r.score for r in L.predict(docs, model).collect()}
    kept = {r.doc_id for r in L.keep_known(docs, model, least=0.1).collect()}
    assert kept == {d for d, x in score.items() if x >= 0.1} and {1, 2, 3} <= kept < lettered
