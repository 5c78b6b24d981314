"""Verdicts come from one written table; sentiment and sets share a review's tokens."""

from reviewtrust.functions.sentiment import with_sentiment
from reviewtrust.functions.text import normalize, tokens
from reviewtrust.plans import trust
from tests.test_review_rules import GENUINE, TEMPLATED, reviews


def test_verdicts_do_not_read_the_reviews_again(spark, tmp_path):
    path = str(tmp_path / "reviews")
    reviews(spark, GENUINE + TEMPLATED).write.parquet(path)
    verdicts, clusters = trust.judged_reviews(spark.read.parquet(path))
    assert not [f for df in (verdicts, clusters) for f in df.inputFiles() if path in f]
    assert verdicts.count() == len(GENUINE + TEMPLATED)


def test_tokens_of_the_text_are_those_of_the_normalized_text(spark):
    texts = ["GREAT İstanbul it's 5/5 Kelvin naïve café 100% £5-6 a_b́c", "", None, "ẞΣς l'̇x²y 'q'"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(tokens(df["text"]).alias("a"), tokens(normalize(df["text"])).alias("b")).collect():
        assert r["a"] == r["b"]
    assert with_sentiment(df, words="w").select("w").collect() == df.select(tokens(df["text"]).alias("w")).collect()
