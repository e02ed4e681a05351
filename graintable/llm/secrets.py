"""Secret scans: candidate strings, and a random forest that removes false positives."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import bounded_sample, id_crc, materialize, table

#: A run of key characters with a digit, of 12 characters or more; and whatever is assigned to a credential's name.
CANDIDATE = re.compile(r"(?<![\w+/.@-])(?=[\w+/.@-]*[0-9])[A-Za-z0-9_+/.@-]{12,}={0,2}", re.ASCII)
ASSIGNED = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|credential)s?[\"']?\s{0,8}[=:]\s{0,8}[\"']?([^\s\"'<>]{4,})", re.ASCII | re.IGNORECASE)
NAMES = re.compile("passw|pwd|token|secret|key|credential", re.IGNORECASE)
# Words that name a secret when they stand next to it, and words of ordinary identifiers and paths.
KEYWORDS = ("password", "passwd", "pwd", "token", "secret", "api", "key", "auth", "credential", "bearer")
PATH_WORDS = ("test", "example", "doc", "readme", "sample", "mock", "fixture", "config", "env")
BUCKETS = 16
FEATURES = 12 + 16 + len(KEYWORDS) + len(PATH_WORDS) + 2 * BUCKETS
#: Context read on either side of a candidate.
AROUND = 40


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(secret: str, before: str, after: str, path: str, known: frozenset[str]) -> list[float]:
    """Length, composition, character transitions, dictionary coverage, path words and neighbouring words."""
    n = len(secret)
    kinds = [_kind(c) for c in secret]
    share = [kinds.count(k) / n for k in range(4)]
    counts: dict[str, int] = {}
    for c in secret:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(x / n * math.log2(x / n) for x in counts.values())
    runs = re.findall(r"[A-Za-z]{3,}", secret)
    covered = sum(len(r) for r in runs if r.lower() in known) / n
    hexes = sum(c in "0123456789abcdefABCDEF" for c in secret) / n
    moves = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[4 * a + b] += 1 / max(n - 1, 1)
    left = re.findall(r"[A-Za-z]+|[=:]", before)
    right = re.findall(r"[A-Za-z]+", after)
    near = "".join(left[-3:]).lower()
    out = [float(n), math.log2(n), *share, entropy, entropy / max(math.log2(n), 1), covered, hexes,
           float("@" in secret), float(before.rstrip(" \"'").endswith(("=", ":")))]
    out += moves
    out += [float(k in near) for k in KEYWORDS]
    low = path.lower()
    out += [float(w in low) for w in PATH_WORDS]
    for words, pick in ((left, -1), (right, 0)):
        hashed = [0.0] * BUCKETS
        if words:
            hashed[sum(ord(c) * (i + 1) for i, c in enumerate(words[pick].lower()[:12])) % BUCKETS] = 1.0
        out += hashed
    return out


def find(text: str) -> list[tuple[int, int]]:
    """Start and end of each candidate, in order; of two that begin alike the longer one."""
    found = {m.start(): m.end() for m in CANDIDATE.finditer(text)}
    if NAMES.search(text):
        for m in ASSIGNED.finditer(text):
            found[m.start(1)] = max(m.end(1), found.get(m.start(1), 0))
    return sorted(found.items())


def candidates(docs: DataFrame, known: frozenset[str], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """id_col, start, length, digest (md5 of the string) and features of every candidate in whole texts; neither the string nor its neighbours leave the task."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text_col, F.col(path_col).cast("string").alias("_p") if path_col else F.lit("").alias("_p")).where(F.col(text_col).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, starts, sizes, digests, rows = [], [], [], [], []
            for i, (value, path) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                text = value.as_py()
                for x, y in find(text):
                    secret = text[x:y]
                    at.append(i)
                    starts.append(x)
                    sizes.append(y - x)
                    digests.append(hashlib.md5(secret.encode()).hexdigest())
                    rows.append(features(secret, text[max(0, x - AROUND):x], text[y:y + AROUND], path.as_py() or "", known))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(rows, pa.list_(pa.float64()))],
                [id_col, "start", "length", "digest", "features"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, digest string, features array<double>")


def generated_findings(words: frozenset[str], n: int = 4000, seed: int = 5) -> list[tuple[int, str, str, int, float]]:
    """n made findings (id, text, path, start, label), half of them secrets: the label is known from how the string was made, not from its features.

    Secrets are random strings of key forms and passwords, assigned to a name or named nearby. The others are addresses, dates, numbers, paths,
    versions, identifiers, digests of files, long words and placeholders. The words around both are drawn from the same dictionary.
    """
    rng = random.Random(seed)
    known = sorted(words) or ["some", "plain", "words"]
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(known)
    date = lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    makes = (
        lambda: draw(hexes, rng.choice((16, 20, 24, 32, 40, 64))), lambda: draw(alnum, rng.randint(14, 48)), lambda: draw(alnum + "+/", rng.choice((24, 40, 44))) + rng.choice(("", "=", "==")),
        lambda: rng.choice(("AKIA", "ASIA")) + draw(string.ascii_uppercase + string.digits, 16), lambda: draw(alnum + "_.-", rng.randint(12, 30)), lambda: draw(alnum + "!#$%&*", rng.randint(8, 16)),
    )
    names = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "auth_token", "client_secret", "access_key", "credential")
    leads = (lambda: f"{rng.choice(names)} = ", lambda: f"{rng.choice(names)}=", lambda: f"{rng.choice(names)}: ", lambda: f'{rng.choice(names)} = "', lambda: f"{rng.choice(names).upper()}=", lambda: "Authorization: Bearer ", lambda: f"{word()} {rng.choice(names)} ")
    others = (
        lambda: (f"{word()} ", f"{word()}.{word()}{rng.randint(1, 99)}@{word()}.com"), lambda: (f"{word()} ", draw(string.digits, rng.randint(12, 19))), lambda: (f"{word()} on ", f"{date()}T{rng.randint(10, 23)}.{rng.randint(10, 59)}"),
        lambda: (f"{word()} in ", f"{word()}/{word()}/{word()}{rng.randint(1, 99)}.txt"), lambda: ("version ", f"{word()}-{rng.randint(1, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}-{word()}"),
        lambda: ("id ", f"{draw(hexes, 8)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 12)}"), lambda: (rng.choice(("sha256 ", "commit ", "checksum ", "digest of it ", "md5 ")), draw(hexes, rng.choice((32, 40, 64)))),
        lambda: (f"{word()} ", f"{word()}_{word()}_{rng.randint(1, 999)}_{word()}"), lambda: (f"{rng.choice(names)} = ", rng.choice(("example", "changeme", "your_password_here", "xxxxxxxx", "<hidden>", "placeholder1234", f"{word()}_{word()}", "$PASSWORD"))),
        lambda: (f"{word()} ", f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"), lambda: (f"see {word()} ", f"www.{word()}{rng.randint(1, 99)}.org/{word()}"),
    )
    out = []
    for i in range(n):
        if i % 2:
            lead, found = rng.choice(leads)(), rng.choice(makes)()
        else:
            lead, found = rng.choice(others)()
        before = " ".join(word() for _ in range(rng.randint(0, 7)))
        text = f"{before}{' ' if before else ''}{lead}"
        path = rng.choice(("", f"src{rng.randint(0, 9)}", f"{word()}/{rng.choice(PATH_WORDS) if not i % 2 else word()}"))
        out.append((i, f"{text}{found}{rng.choice((' ', chr(10), chr(34) + ' ', '. '))}{word()} {word()}", path, len(text), float(i % 2)))
    return out


def common_words(docs: DataFrame, text_col: str = "text", size: int = 5000) -> frozenset[str]:
    """The `size` most frequent letter runs of all documents: the dictionary of the coverage feature (at most that many reach the driver)."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    return frozenset(r[0] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect())


def fit_forest(labelled: DataFrame, trees: int = 30, depth: int = 9, rows: int = 20_000, id_col: str = "doc_id") -> RandomForestClassificationModel | None:
    """A forest of the findings' features, fit on at most `rows` labelled findings; None where a label is missing."""
    known = labelled.where("label is not null").withColumn("_k", F.xxhash64(F.col(id_col), "start"))
    some = materialize(bounded_sample(known.where("label = 1"), "_k", rows // 2).unionByName(bounded_sample(known.where("label = 0"), "_k", rows // 2))
                       .select("label", "features"), "secret-training")
    if len(some.groupBy("label").count().take(2)) < 2:
        return None
    data = some.select("label", array_to_vector("features").alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(data)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         threshold: float = 0.5, held_out_mod: int = 5) -> DataFrame:
    """id_col, start, length, digest, held_out, score, is_secret for every candidate string of whole texts.

    A candidate is a run of 12 key characters or more with a digit, or whatever of 4 characters or more is assigned to a credential's name.
    findings (id_col, start, label) are reviewed findings of docs; the forest learns from those whose id's crc32 mod held_out_mod
    isn't 0, and from generated_findings(), whose labels are known from how they were made; without findings from these alone, so
    that nothing of docs is learned from. Null and empty texts have no candidates; repeated rows give repeated candidates;
    an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    words = common_words(docs, text_col)
    found = materialize(candidates(docs, words, id_col, text_col, path_col), "secret-candidates")
    made = spark.createDataFrame(generated_findings(words), "made_id long, text string, path string, start long, label double")
    labelled = candidates(made, words, "made_id", "text", "path").join(made.select("made_id", "start", "label"), ["made_id", "start"]).select("start", "label", "features", F.col("made_id").alias("_f"))
    learn = id_crc(F.col(id_col)) % held_out_mod != 0
    if findings is not None:
        own = found.where(learn).join(findings.select(id_col, "start", F.col("label").cast("double").alias("label")), [id_col, "start"])
        labelled = labelled.unionByName(own.select("start", "label", "features", F.xxhash64(id_col).alias("_f")))
    model = fit_forest(labelled, id_col="_f")
    model.setFeaturesCol("v")
    scored = model.transform(found.withColumn("v", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select(id_col, "start", "length", "digest", (~learn).alias("held_out"), F.round("score", 9).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate string of documents with the forest's score (see scan)."""
    return scan(table(spark, sf_dir, "documents"))
