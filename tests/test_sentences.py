"""Sentences with and without regard to abbreviations."""

from sayframe.operators.sentences import sentences
from sayframe.queries import QUERIES
from tests.test_prepare import make


def test_abbreviations_end_sentences_only_where_asked(spark, tmp_path):
    units = make(spark, "St. Anne left. Dr. Lee stays.")
    texts = lambda rows: [r["text"] for r in rows.orderBy("index").collect()]
    assert texts(sentences(units)) == ["St. Anne left.", "Dr. Lee stays."]
    assert texts(sentences(units, abbreviations=False)) == ["St.", "Anne left.", "Dr.", "Lee stays."]
    spark.createDataFrame([(1, 0, "user", "St. Anne left.")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert texts(QUERIES["sentence_spans"](spark, str(tmp_path))) == ["St.", "Anne left."]
