"""Secret scans with a random forest that removes false positives.

Candidates are (a) values of 4 signs or more, of any but white space and the quotes around them, that a credential's name
is assigned, (b) passwords of URLs and lines of private keys in their blocks, and (c) other runs of 16 or more secret-like signs with at least one digit or mixed
case, without the name and its = or : where they lead. Values of (a) without quotes end at , ; and brackets, in a query string
at &, and need a digit, a sign or mixed case. Where (a) or (b) has a value, (c) has none, but for the whole URL. Each is described by its
length, a beginning that services give their tokens, the transitions between kinds of characters, its entropy, the share of it that dictionary words cover, whether
it looks like a path, address or number, and the words beside it. A forest trained from labelled findings gives each
candidate the probability of being a secret.

``features`` finds and describes candidates, ``describe_labelled`` those of labelled findings, ``train`` fits a forest from
them, ``scan`` scores. Labelled findings are lines in which a value is marked as a secret or not (``findings`` makes a
table of them where no team has judged its own): no rule over the features labels anything. So the corpus is read in one pass.
Training takes a bounded sample (``max_train`` findings of the smallest hashes, 20,000 by default); candidates and scores
cover all documents. ``silver_labels`` is a plain rule to compare a forest with.

Null and empty texts have no candidates. Repeated rows, also of one or of a null id, are scanned each. Very long texts are read whole.
With labels of one kind only, there is no forest and the rule (0.5 where it is unclear) is the score. Other columns take no part.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .findings import SCHEMA as FINDINGS
from .findings import labelled_findings

MAX_TRAIN, TREES, DEPTH = 20_000, 20, 6

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@:\-]{16,}")
_NAME = re.compile(r"(?i)(token|secret|passw|pwd|api_?key|access_?key|private_?key|credential|auth(?!or(?!i[sz]))|bearer)")
_LEAD = re.compile(r"[A-Za-z][A-Za-z0-9_.\-]*[=:](?!//)(?=[^=:])")
_ASSIGNED = re.compile(_NAME.pattern + r"""[\w.\-]{0,60}["']?\s{0,8}(?:=>|:=|==?|:(?!//))\s{0,8}(?:(?:bearer|basic)\s+)?(?:"([^"\s]{4,})"|'([^'\s]{4,})'|([^\s"'`<>,;(){}\[\]]{4,}))""")
_URL_PASSWORD = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]{0,30}://[^\s/:@"'<>]*:([^\s/"'<>]{1,1000})@""")
_ADDRESS = re.compile(r"://|^[^@\s]+@[\w\-]+(\.[\w\-]+)*\.[A-Za-z]{2,}$")
_WORDS = re.compile(r"[A-Za-z]{3,}")
_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----([^-]*)")
#: fixed values: how tokens begin that services issue, and how names end of what is no credential
_ISSUED = re.compile(r"(AKIA|ASIA|AIza|gh[opsru]_|github_pat_|glpat-|npm_|pypi-|[rs]k_live_|[rs]k_test_|sk-|xox[abprs]-|SG\.|hf_|dop_v1_|eyJ)")
_HARMLESS = re.compile(r"(?i)(commit|sha\d*|rev|revision|checksum|digest|etag|uuid|guid|id|version|url|uri|file|path|expires|count)[\"'\]]*$")
_KINDS = ("digit", "lower", "upper", "sign")
FEATURES = [
    "length", "digit", "lower", "upper", "sign", "entropy", "runs", *(f"{a}_{b}" for a in _KINDS for b in _KINDS if a != b),
    "dictionary", "hex", "slashes", "dots", "address", "number", "issued", "harmless", "named", "assigned", "quoted", "words_before", "words_after",
]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def candidates(text: str) -> list[tuple[int, str, bool]]:
    """(start, value, whether it stands where a credential does) in order, start in code points."""
    out, taken, urls = [], [], []
    for m in _URL_PASSWORD.finditer(text):
        out.append((m.start(1), m[1], True))
        urls.append(m.span(1))
    whole, begins, ends = set(urls), [a for a, _ in urls], [b for _, b in urls]  # these stand apart and in order
    at = 0
    while m := _ASSIGNED.search(text, at):
        group = m.lastindex
        start, value = m.start(group), m[group]
        at = m.end()
        if group == 4:
            name = re.search(r"[\w.\-]*$", text[max(0, m.start() - 80) : m.start()]).start() + max(0, m.start() - 80)
            if name and text[name - 1] in "?&":
                value = value.split("&")[0]
            value = value.rstrip(".:")
            if len(value) < 4 or not re.search(r"\d|[a-z][A-Z]|[^A-Za-z0-9]", value):
                at = start  # a name may be the word before another
                continue
        if "://" in value:
            at = start
            continue
        out.append((start, value, True))
        taken.append((start, start + len(value)))
    blocks = [m.span(1) for m in _BLOCK.finditer(text)]
    i = j = 0
    for m in _CANDIDATE.finditer(text):
        value, start = m[0].rstrip(".:=-"), m.start()
        while lead := _LEAD.match(value):
            if len(value) - lead.end() < 16 and not _NAME.search(lead[0]):
                break
            start, value = start + lead.end(), value[lead.end() :]
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        inside = i < len(taken) and taken[i][0] < start + len(value)
        if inside or (start, start + len(value)) in whole or len(value) < 16 or not (re.search(r"\d", value) or re.search(r"[a-z][A-Z]", value)):
            continue
        # a piece of a password in a URL is no candidate of its own; the whole URL is
        first, last = bisect_right(ends, start), bisect_left(begins, start + len(value)) - 1
        if first <= last and (urls[first][0] < start or urls[last][1] > start + len(value)):
            continue
        while j < len(blocks) and blocks[j][1] <= start:
            j += 1
        out.append((start, value, j < len(blocks) and blocks[j][0] <= start))
    return sorted(out)


def describe(value: str, before: str, after: str, dictionary: frozenset[str], credential: bool = False) -> list[float]:
    """FEATURES of a candidate between the texts before and after it; credential: a name or a URL makes it one."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    steps = Counter(zip(kinds, kinds[1:], strict=False))
    entropy = -sum(x / n * math.log2(x / n) for x in Counter(value).values())
    covered = sum(len(w) for w in _WORDS.findall(value) if w.lower() in dictionary)
    tail = before[-40:]
    assigned = re.search(r"[=:]\s*[\"']?$", tail) is not None
    name = re.split(r"\s+", re.sub(r"\s*[=:]?\s*[\"']?$", "", tail))[-1]
    word_like = lambda t: float(bool(re.fullmatch(r"[^\W\d_]+[.,;:?!]*", t)))
    left, right = before.split()[-1:] or [""], after.split()[:1] or [""]
    return [
        float(n), *share, entropy, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(n - 1, 1),
        *(steps[(a, b)] / max(n - 1, 1) for a in range(4) for b in range(4) if a != b),
        covered / n, float(re.fullmatch(r"(?i)[0-9a-f]+", value) is not None), value.count("/") / n, value.count(".") / n,
        float(_ADDRESS.search(value) is not None), float(re.fullmatch(r"[\d.:\-+]+", value) is not None),
        float(_ISSUED.match(value) is not None), float(_HARMLESS.search(name) is not None), float(credential or _NAME.search(name) is not None), float(credential or assigned), float(tail[-1:] in "\"'" and tail != "" and after[:1] == tail[-1:]),
        word_like(left[0]), word_like(right[0]),
    ]


def features(docs: DataFrame, dictionary: Iterable[str], id_col: str = "doc_id") -> DataFrame:
    """(id, start, value, x): every candidate of every document, start being its place in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for start, value, credential in candidates(text or ""):
                    end = start + len(value)
                    rows.append((i, start, value, describe(value, text[max(0, start - 80) : start], text[end : end + 80], known, credential)))
            if rows:
                at, start, value, x = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(start, pa.int64()), pa.array(value), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "start", "value", "x"])

    schema = docs.select(id_col).schema.add("start", "long").add("value", "string").add("x", T.ArrayType(T.DoubleType()))
    return docs.select(id_col, "text").mapInArrow(run, schema)


def _x(name: str):
    return F.col("x")[FEATURES.index(name)]


def silver_labels(found: DataFrame) -> DataFrame:
    """found with label: 1 for values in a credential's place, 0 for addresses, and elsewhere for hosts, paths, numbers and words; else null.

    In a credential's place, words, numbers and paths stay unclear.
    """
    credential, address = (_x("named") == 1) & (_x("assigned") == 1), _x("address") == 1
    words = ((_x("dictionary") >= 0.5) & (_x("digit") == 0)) | (_x("digit") + _x("upper") + _x("sign") == 0)
    path = F.col("value").rlike(r"^[.~]{0,2}/") & (_x("slashes") > 0.1)
    elsewhere = (_x("number") == 1) | (_x("dictionary") >= 0.5) | (_x("slashes") > 0.1) | (_x("digit") + _x("upper") == 0)
    return found.withColumn("label", F.when(address | (~credential & elsewhere), 0).when(credential & ~words & ~path & (_x("number") == 0), 1))


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, seed: int = 1):
    """A forest from rows with x and label (0, 1; null rows are left out); None unless both labels occur.

    The sample is the ``max_train`` rows of the smallest hashes, in that order, in one partition: reruns agree.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled.where("label is not null").select(F.col("label").cast("double").alias("label"), "x", F.xxhash64("value", "x").alias("h"))
    sample = rows.orderBy("h", "x").limit(max_train).coalesce(1).select("label", array_to_vector("x").alias("vector")).cache()
    try:
        if {r[0] for r in sample.select("label").distinct().collect()} != {0.0, 1.0}:
            return None
        return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, cacheNodeIds=False).fit(sample)
    finally:
        sample.unpersist()


def scan(found: DataFrame, model) -> DataFrame:
    """found with score, the probability that a candidate is a secret."""
    if model is None:
        return silver_labels(found).withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.5))).drop("label")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return model.transform(found.withColumn("vector", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")


def describe_labelled(findings: DataFrame, dictionary: Iterable[str]) -> DataFrame:
    """(finding, value, x, label, form) of the candidates that overlap the marked value of findings.SCHEMA rows."""
    marked = findings.select("finding", F.col("start").alias("at"), "n_chars", "label", "form")
    found = features(findings, dictionary, "finding").join(marked, "finding")
    return found.where("start < at + n_chars and start + length(value) > at").select("finding", "value", "x", "label", "form")


def default_findings(spark) -> DataFrame:
    return spark.createDataFrame(labelled_findings(), FINDINGS)


_fitted: dict[tuple[str, frozenset[str]], object] = {}


def default_model(spark, dictionary: frozenset[str]):
    """The forest of ``default_findings``, fitted once a session and dictionary; the last one is kept."""
    key = (spark.sparkContext.applicationId, dictionary)
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = train(describe_labelled(default_findings(spark), dictionary))
    return _fitted[key]


def secrets(docs: DataFrame, dictionary: Iterable[str], labelled: DataFrame | None = None, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id, start, value, score, is_secret) of every candidate; ``labelled`` has value, x and label, by default those of ``default_findings``."""
    dictionary = frozenset(dictionary)
    model = default_model(docs.sparkSession, dictionary) if labelled is None else train(labelled)
    return scan(features(docs, dictionary, id_col), model).select(id_col, "start", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings without their values: place, length and SHA-256."""
    return df.select(id_col, "start", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
