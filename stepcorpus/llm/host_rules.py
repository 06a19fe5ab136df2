"""Quality rules of a document and of its host, in built-in functions only.

A document's counts come from array expressions in its own row.  Failures
are summed by host (``source``) with map-side partial sums; a host's failure
rate is shrunk towards the corpus rate with a beta prior whose two
parameters are fitted to the spread between hosts; a host whose shrunk rate
is above ``HOST_LIMIT`` fails, and with it all its documents.

A null text has no words; a null ``source`` counts as the host ''.  Rows
that repeat a doc_id are judged and returned one by one.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepcorpus.session import broadcast_if_small, materialize

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
HOST_LIMIT = 0.5
MAX_PRIOR = 1e6  # documents that the prior weighs at most: hosts that don't differ


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _windows(hashes: Column, size: int) -> Column:
    """A hash of each run of ``size`` hashes; null where there are fewer."""
    n = F.size(hashes)
    if size == 1:
        return hashes
    return let(_windows(hashes, size - 1), lambda g: F.slice(
        F.zip_with(g, F.slice(hashes, size, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - (size - 1), F.lit(0))))


def _covered(g: Column, size: int) -> Column:
    """Words inside windows whose hash occurs twice or more, from the windows' hashes in text order."""
    by_hash = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("next")))
        return let(same, lambda m: F.sort_array(F.filter(
            F.zip_with(m, F.concat(F.array(F.lit(False)), F.transform(m, lambda x: x["next"])), lambda a, before: F.when(a["next"] | before, a["i"])), lambda i: i.isNotNull())))

    return F.aggregate(let(by_hash, positions), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
                       lambda a, p: F.struct((a["n"] + p + size - F.greatest(p, a["upto"])).alias("n"), (p + size).alias("upto")), lambda a: a["n"])


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside ``size``-word windows found twice or more in the same text."""
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _windows(h, size))
    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g, size)))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    per_text = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    per_line = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = (docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("text"))
           .select("doc_id", "host", per_text.alias("t"), (F.size(F.split("text", SYMBOLS)) - 1).alias("n_symbols"), per_line.alias("n_dup_lines")))
    return out.select("doc_id", "host", *(F.col(c).cast("long").alias(c.removeprefix("t.")) for c in ("t.n_words", "t.word_chars", "n_symbols", "n_dup_lines", "t.n_repeat_words")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_failed, from rows with ``host`` and ``base_failed``."""
    hosts = materialize(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    n, failed, n_hosts = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count(F.lit(1))).first()
    mean = failed / n if n else 0.0
    spread = hosts.agg(F.sum(F.pow(F.col("n_failed") - mean * F.col("n_docs"), 2) / F.col("n_docs"))).first()[0] or 0.0
    # variance between hosts: what the rates spread beyond the binomial noise of n_hosts samples
    between = max(0.0, (spread - mean * (1 - mean) * n_hosts) / n) if n else 0.0
    weight = min(MAX_PRIOR, max(1.0, mean * (1 - mean) / between - 1)) if between else MAX_PRIOR
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", F.col("host_rate") > limit)


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base_failed, host verdict and kept of every document."""
    judged = materialize(document_counts(docs).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "doc-counts")
    hosts, _ = broadcast_if_small(materialize(host_verdicts(judged, limit).select("host", F.round("host_rate", 6).alias("host_rate"), "host_failed"), "host-verdicts"))
    return judged.join(hosts, "host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


SQL = f"""
with t as (select doc_id, coalesce(source, '') host, coalesce(text, '') s from documents),
w as (select doc_id, host, s, regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+') ws, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from t),
win as (select doc_id, i, ws[i:i+{WINDOW - 1}] g from w, unnest(generate_series(1, len(ws) - {WINDOW - 1})) u(i)),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) c from win),
cov as (select doc_id, count(distinct i + k) n from rep, unnest(generate_series(0, {WINDOW - 1})) v(k) where c > 1 group by doc_id),
j as (select doc_id, host, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
  (length(s) - length(regexp_replace(s, '{SYMBOLS}', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words
  from w left join cov using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from j),
h as (select host, count(*) n_docs, count(*) filter (base_failed) n_failed from b group by host),
m as (select sum(n_docs) n, sum(n_failed)::double / sum(n_docs) mean, count(*) n_hosts from h),
s as (select m.*, (select sum(pow(n_failed - m.mean * n_docs, 2) / n_docs) from h) spread from m),
p as (select mean, greatest(0, (spread - mean * (1 - mean) * n_hosts) / n) between_hosts from s),
q as (select mean, case when between_hosts > 0 then least({MAX_PRIOR}, greatest(1, mean * (1 - mean) / between_hosts - 1)) else {MAX_PRIOR} end weight from p),
v as (select host, (n_failed + mean * weight) / (n_docs + weight) rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= {HOST_LIMIT} kept, round(rate, 6) host_rate
from b join v using (host)
"""
