"""Quality rules of documents, judged by host.

Each document is measured once, in the tasks that read it. Failures of the host rules are
summed by host, the rates are shrunk towards a beta prior fitted to all hosts, and hosts whose
shrunk rate is over a rule's limit are joined back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed
from .words import Words, counts, flat, pieces, repeats

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((m, pa.int64()) for m in MEASURES)])


def _measured(batches):
    for batch in batches:
        text, offsets = flat(batch["text"])
        out = [[] for _ in MEASURES]
        for first, last in pieces(offsets):
            w = Words(text, offsets, first, last)
            n = w.n_docs
            letters = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
            symbols = np.r_[0, np.cumsum(_SYMBOL[w.data])]
            line_doc, line_hash = w.lines()
            again = repeats(line_doc, line_hash)[0]
            start, h = w.windows(3)
            hot = start[repeats(w.doc[start], h)[1]]
            covered = np.zeros(len(w.start), bool)
            for k in range(3):
                covered[hot + k] = True
            found = (np.diff(w.at), counts(w.doc, n, letters[w.end] - letters[w.start]), np.diff(symbols[w.bounds]), counts(line_doc[again], n), counts(w.doc[covered], n))
            for column, x in zip(out, found, strict=True):
                column.append(x)
        yield pa.record_batch([batch["doc_id"], batch["host"], *(pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out)], schema=_SCHEMA)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and MEASURES of each document. Null text: all 0."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return thin.mapInArrow(_measured, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Host rules: a document's failure, and the shrunk rate of failing documents from which its host goes.
HOST_RULES = {
    "base": (base_failed, 0.5),
    "symbols": (lambda: 10 * F.col("n_symbols") > F.col("n_words"), 0.5),
    "dup_lines": (lambda: (F.col("n_dup_lines") > 0) & (100 * F.col("n_dup_lines") > 5 * F.col("n_words")), 0.5),
    "word_length": (lambda: (F.col("n_words") > 0) & ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))), 0.5),
}


def host_verdicts(measured: DataFrame, rules: dict = HOST_RULES) -> DataFrame:
    """host, docs, and for each rule failed_<rule> and rate_<rule> (shrunk), and rejected.

    The prior's mean is the share of failures in all documents; its weight comes from the
    spread of hosts' rates by moments: what the spread has beyond binomial noise. With one host or no
    extra spread, the weight is at its upper end and all hosts get the mean.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), *(F.sum(bad().cast("int")).alias(f"failed_{r}") for r, (bad, _) in rules.items()))
    hosts = checkpointed(hosts)
    total = hosts.agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("docs")).alias("n2"), F.count("*").alias("k"), *(F.sum(f"failed_{r}").alias(r) for r in rules)).first()
    n, k = total["n"] or 0, total["k"]
    mean = {r: total[r] / n if n else 0.0 for r in rules}
    spread = hosts.agg(*(F.sum(F.col("docs") * F.pow(F.col(f"failed_{r}") / F.col("docs") - F.lit(m), F.lit(2))).alias(r) for r, m in mean.items())).first()
    out, gone = hosts, F.lit(False)
    for r, (_, limit) in rules.items():
        noise = mean[r] * (1 - mean[r])
        # weighted between-host variance, as in the beta-binomial's method of moments
        room = n - (total["n2"] or 0) / n if n else 0.0
        between = ((spread[r] or 0.0) - (k - 1) * noise) / room if room > 0 else 0.0
        weight = min(1e6, max(2.0, noise / between - 1)) if between > 0 else 1e6
        rate = (F.col(f"failed_{r}") + F.lit(weight * mean[r])) / (F.col("docs") + F.lit(weight))
        out = out.withColumn(f"rate_{r}", rate)
        gone |= rate > limit
    return out.withColumn("rejected", gone)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, MEASURES, base_failed, host_rejected and kept for each row of docs.

    A document goes if it fails the base rules (under 50 words, or more than half of its words in repeated
    3-word windows) or if its host is rejected. Null and empty texts have no words and fail. Documents
    without a host are judged alone. Repeated rows and null ids count each. Texts of any length are measured whole; a rate that is a
    rule's limit exactly does not reject. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    measured = checkpointed(measures(docs, id_col, text_col, host_col))
    hosts = host_verdicts(measured.where(F.col("host").isNotNull()))
    out = measured.join(hosts.select("host", F.col("rejected")), "host", "left")
    judged = out.withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("rejected", F.lit(False))})
    return judged.select("doc_id", "host", *MEASURES, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))
