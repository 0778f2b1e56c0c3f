"""Language labels by a linear model over code tokens.

The scorer of the system whose queries these are is not public in its tree. Ours keeps its contract, eight languages, at least
ten characters, a threshold of 5, `unknown` otherwise; its labels are its own. Its weights are fitted in the session, by
multinomial naive Bayes over generated snippets: a token's weight for a language is how much likelier it is there than in
prose, in tenths. A text is cut into tokens once, and those that have weights are added up.
"""

from __future__ import annotations

import json
from zlib import crc32

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_units, trim
from ..sources.snippets import NONE, STATEMENTS, training
from .normalize import normalize, once

THRESHOLD, SHORTEST = 5, 10
#: Tenths in which weights are counted, and training snippets that a token must be in.
TENTHS, LEAST = 10, 8
#: Words of two letters or more, and signs that few languages have. It means the same in Java and RE2.
TOKEN = r"[A-Za-z_]{2,}|#[a-z]+|<-|%>%|=>|->|===|!==|::|<<|>>|\?\.|[{};]"
#: Of equal scores the first counts.
LANGUAGES = tuple(STATEMENTS)
#: Our own choice of other names that a fence may give; they are kept as written.
ALIASES = ("py", "js", "jsx", "ts", "tsx", "c++", "cc", "h", "hpp", "kt", "kts", "mysql", "rscript")
#: Maps by which tokens are looked up: Spark searches a map from its beginning, so each holds few.
MAPS = 1024
#: Weights by application.
_FITTED: dict[str, dict[str, tuple[int, ...]]] = {}


def weights(spark: SparkSession) -> dict[str, tuple[int, ...]]:
    """Of each token its weight, in tenths, for each of LANGUAGES; fitted once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        labels = {name: k for k, name in enumerate((*LANGUAGES, NONE))}
        rows = spark.createDataFrame([(float(labels[lang]), text) for lang, text in training()], "label double, text string")
        rows = rows.withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
        counts = CountVectorizer(inputCol="tokens", outputCol="features", minDF=LEAST).fit(rows)
        theta = NaiveBayes(modelType="multinomial", smoothing=1.0).fit(counts.transform(rows)).theta.toArray()
        tenths = ((theta[:-1] - theta[-1]) * TENTHS).round().astype(int)
        _FITTED[app] = {token: tuple(map(int, tenths[:, k])) for k, token in enumerate(counts.vocabulary)}
    return _FITTED[app]


def _maps(tokens: list[str]) -> list[dict[str, int]]:
    """The place of each token, in the map of its checksum."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for i, token in enumerate(tokens):
        maps[crc32(token.encode()) % MAPS][token] = i
    return maps


def scores(code: Column) -> Column:
    """array<int>: of each of LANGUAGES the sum of the tokens' weights."""
    known = sorted(weights(SparkSession.active()).items())
    # As JSON, which is one call of the JVM and is parsed once, when the plan is made.
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    places = constant(_maps([token for token, _ in known]), "array<map<string,int>>")
    place = lambda t: F.try_element_at(F.get(places, (F.crc32(t) % MAPS).cast("int")), t)
    columns = [constant([w[k] for _, w in known], "array<int>") for k in range(len(LANGUAGES))]
    found = F.filter(F.transform(F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)), place), lambda i: i.isNotNull())
    total = lambda at, column: F.aggregate(at, F.lit(0), lambda a, i: a + F.get(column, i))
    return once(found, lambda at: F.array(*(total(at, column) for column in columns)))


def detect(code: Column) -> Column:
    best = lambda s: F.struct(F.array_max(s).alias("top"), F.array_position(s, F.array_max(s)).alias("at"))
    label = lambda b: F.when(b["top"] >= THRESHOLD * TENTHS, F.element_at(F.array(*map(F.lit, LANGUAGES)), b["at"].cast("int"))).otherwise("unknown")
    found = once(once(once(normalize(code), scores), best), label)
    return F.when(has_units(trim(code), SHORTEST), found).otherwise("unknown")


def known(hint: Column) -> Column:
    return hint.isin(*LANGUAGES, *ALIASES)
