import base64
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from loomline.llm import byte_bpe, mixing


def test_stages_pass_documents_on(spark, docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "byte_bpe"]
    for table in (docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, "")
            assert out.columns == docs.columns, name
            path = corpus_pipeline.scratch.new_path(spark, "test")
            out.write.parquet(path)
            now = spark.read.schema(docs.schema).parquet(path)
        last = corpus_pipeline.STAGES[-1][1](spark, now, "")
        assert last.count() == now.count()


def survivors(rows):
    """Documents that brute force leaves for the mix: lettered, first of equal texts, first of near ones."""
    first = {}
    for doc, text in sorted(rows):
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if any(c.isalpha() for c in plain):
            first.setdefault(plain, (doc, text))
    docs = sorted(first.values())
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    least = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    return [docs[i] for i in range(len(docs)) if least[i] == i]


def test_run(spark, tmp_path):
    """The rows of the whole pipeline are those of brute force, taken as often as the mix says, with tiktoken's ids."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(80)]
    texts = [" ".join(r.choices(words, k=r.randint(8, 60))) for _ in range(40)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:6]] + [t + " tail" for t in texts[6:12] if t.count(" ") > 25] + ["", None, "12 !!", "x", "Ünïcödé 日本語 🙂"]
    source = {i: r.choice(["a", "b", None]) for i in range(len(texts))}
    rows = [(i, t, r.choice(["en", "de", None]), source[i], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    left = survivors([x[:2] for x in rows])
    assert 30 < len(left) < 45
    mix = mixing.mix(spark.createDataFrame([(d, t, source[d]) for d, t in left], "doc_id long, text string, source string"))
    want = {x.doc_id: (x.epochs, x.cut) for x in mix.collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.RANKS), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(x.doc_id, []).append(list(x.ids))
    text = dict(left)
    assert set(got) == {d for d, (e, c) in want.items() if e or c}
    for d, ids in got.items():
        epochs, cut = want[d]
        whole = tik.encode_ordinary(text[d])
        assert len(ids) == epochs + (cut > 0) and sum(i == whole for i in ids) >= epochs
        part = [i for i in ids if i != whole]
        assert all(len(re.findall(r"[^\x20\x09-\x0D]+", tik.decode(p))) == cut for p in part)
