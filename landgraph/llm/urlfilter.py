"""URL filter: allow and block rules first, else a logistic regression on hashed n-grams.

Host, path and the rules are DataFrame expressions.  What no rule fits is judged by a logistic
regression on hashed character n-grams of host and path.  It is trained on the driver from a small
labelled URL table (``LABELLED``, or one's own of at most ``MAX_LABELLED`` rows), and its weights,
of fixed size, go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, need

#: (rule, verdict); a rule is host/path: it fits the host and its subdomains, and paths that begin so.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_LABELLED, MAX_RULES = 20_000, 1_000
DIMENSIONS, GRAMS = 1 << 16, (3, 4, 5)

#: Words of site names, by label, and words that either kind may add; ``labelled_urls`` makes URLs of them.
#: The allowed ones are common nouns of English, French, German and Spanish.
BLOCKED_WORDS = """cheap casino bet bets poker jackpot slots betting gamble pill pills pharma viagra meds adult xxx porn sexy nude spam
warez torrent phish malware popup payday loans replica crack cracks lottery escort""".split()
ALLOWED_WORDS = """library museum history science research news weather garden recipe travel school software wiki hospital
council railway theatre poetry book chess hiking photo maps astronomy physics law economy music house water river mountain
street animal kitchen teacher family health sport village letter paper window morning summer
maison ville jardin livre école musée cuisine voyage histoire nature enfant monde langue marché lumière montagne rivière
haus stadt garten buch schule museum küche reise geschichte natur kinder welt sprache zeitung wetter berg fluss wissenschaft
casa ciudad libro escuela museo cocina viaje historia naturaleza mundo lengua mercado noticias tiempo montaña ciencia""".split()
ADDED_WORDS = "online best free my club world top win now x 24 the".split()
#: How much the blocked URLs count against the allowed ones: what resembles neither is let through.
BLOCKED_SHARE = 0.4


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 if it should be blocked), the default training table: every word on several hosts, with any added word."""
    out = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for k, word in enumerate(words):
            for j, (sub, top) in enumerate(product(("", "www.", "m.", "shop."), ("com", "net", "org", "info"))):
                added = ADDED_WORDS[(5 * k + j) % len(ADDED_WORDS)]
                name = (word, f"{added}-{word}", f"{word}-{added}", f"{word}{added}")[(k + j) % 4]
                path = ("", "/", f"/{ADDED_WORDS[j % len(ADDED_WORDS)]}/{37 * k + 911 * j}", f"/{word}/{j}.html", "/en/", f"/page/{k}")[(k + 2 * j) % 6]
                out.append((f"https://{sub}{name}.{top}{path}", label))
    return out


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all n-grams of bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    docs, buckets = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + b[k : k + m]
        inside = doc[:m] == doc[n - 1 : n - 1 + m]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        docs.append(doc[:m][inside])
        buckets.append((h[inside] % np.uint64(DIMENSIONS)).astype(np.int64))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(docs), np.concatenate(buckets)


class UrlModel:
    """Logistic regression; a URL's n-grams count 1 / sqrt(their number) each."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        doc, bucket = _grams(texts)
        total = np.bincount(doc, minlength=len(texts))
        return self.bias + np.bincount(doc, self.weights[bucket], minlength=len(texts)) / np.sqrt(np.maximum(total, 1))

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -40, 40)))

    @classmethod
    def fit(cls, texts: Sequence[str], labels: Sequence[int], rounds: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> UrlModel:
        doc, bucket = _grams(texts)
        used, column = np.unique(bucket, return_inverse=True)
        value = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))[doc]
        y = np.asarray(labels, dtype=float)
        weight = np.where(y > 0, BLOCKED_SHARE / max(1, y.sum()), (1 - BLOCKED_SHARE) / max(1, (1 - y).sum()))
        w, bias = np.zeros(len(used)), 0.0
        for _ in range(rounds):
            margin = bias + np.bincount(doc, w[column] * value, minlength=len(texts))
            error = weight * (1 / (1 + np.exp(-margin)) - y)
            w -= rate * 10 * (np.bincount(column, error[doc] * value, minlength=len(used)) + ridge * w)
            bias -= rate * error.sum()
        full = np.zeros(DIMENSIONS)
        full[used] = w
        return cls(full, float(bias))


def _features(host: str, path: str) -> str:
    return f"^{host}|{path}$"


def _split(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    stop = min((k for k in (rest.find(c, end) for c in "?#") if k >= 0), default=len(rest))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), rest[end:stop]


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, url_column: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` (that it should be blocked) and ``verdict``.

    The longest rule that fits decides (of equally long ones the first); else the regression does,
    at ``threshold``.  A null URL or one without ``://`` has an empty host and path, fits no rule
    and gets the regression's verdict on the empty text.  Input columns of the five names are
    replaced; all others, and all rows, repeated ones too, stay.
    """
    need(pages, url_column)
    labelled = labelled_urls() if labelled is None else list(labelled)
    if len(labelled) > MAX_LABELLED or len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs and {MAX_RULES} rules")
    bounded_batches(pages.sparkSession, 2048)
    model = UrlModel.fit([_features(*_split(u)) for u, _ in labelled], [y for _, y in labelled])
    url, given = F.col(url_column), pages.columns
    taken = lambda name: next(n for n in (f"_{name}{k}" for k in range(len(given) + 1)) if n not in given)
    own_host, own_path = taken("host"), taken("path")
    pages = pages.withColumns({own_host: host_of(url), own_path: path_of(url)})
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(reversed(rules), key=lambda r: len(r[0])):  # the longest is asked first
        host, _, path = text.partition("/")
        fits = ((F.col(own_host) == host) | F.col(own_host).endswith(f".{host}")) & F.col(own_path).startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series(model.scores([_features(h, p) for h, p in zip(hosts, paths, strict=True)]))

    scored = pages.withColumns({"rule": rule, "verdict": verdict, "score": score(own_host, own_path)})
    scored = scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))
    return scored.drop("host", "path").withColumnsRenamed({own_host: "host", own_path: "path"})


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL under the fixed rules and the regression."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
