"""Document and host rules: literal recount, edge rows, the shrinkage."""
import random
import re

from stepcorpus.llm import host_rules as H


def recount(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(H.SYMBOLS, text)), len(lines) - len(set(lines)), len(hit))


def test_counts_against_a_recount(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t\r\x0b\x0c", "a", "x" * 9000, "a b c d e", "a b c d e a b c d e", "a " * 50, " lead", "trail \n\n trail \n x\r\nx\r\n", "é\x85ü\xa0 <b>|#", "  a"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["p q", "", "r $", " "]) for _ in range(rng.randrange(12))) for _ in range(20)]
    rows = [(i, t, f"s{i % 3}", "x") for i, t in enumerate(texts)]
    got = H.document_counts(spark.createDataFrame(rows, "doc_id long, text string, source string, host string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == recount(texts[r.doc_id]), texts[r.doc_id]


def test_hosts_shrink_towards_the_corpus(spark):
    good, bad = " ".join(f"w{i}" for i in range(12)), "short"
    rows = [(f"good{h}", good) for h in range(20) for _ in range(50)] + [("bad", bad)] * 40 + [("bad", good)] * 2 + [("one", bad), (None, good), ("", good)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = H.judge(docs).collect()
    assert len(out) == len(rows)
    by = {r.host: r for r in out}
    assert by["bad"].host_failed and by["bad"].host_rate < 40 / 42 and not by["good1"].host_failed
    assert 0.01 < by["one"].host_rate < 1 and "" in by
    assert all(r.kept == (not r.base_failed and r.host != "bad" and not r.host_failed) for r in out)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None)] * 3 + [(None, None, None)], "doc_id long, text string, source string")
    assert H.judge(docs.limit(0)).collect() == []
    assert sorted(str(r.doc_id) for r in H.judge(docs).collect()) == ["1", "1", "1", "None"]
