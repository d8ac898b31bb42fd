from kgspark.sources import readers, sinks


def test_definitions_come_back_as_they_are(spark, tmp_path):
    texts = ["a\r\nb", "c\rd", "", None, 'q"x"\\', " lead ", "e\nf", "\r", ",", "\n", "'", "\t"]
    rows = [(t, f"t{i}", None if i % 2 else "", "d\r") for i, t in enumerate(texts)]
    sinks.definitions_csv(spark.createDataFrame(rows, "text string, triplets string, relations string, definitions string"), str(tmp_path / "x"))
    assert sorted(map(tuple, readers.definitions_csv(spark, str(tmp_path / "x")).collect()), key=str) == sorted(rows, key=str)
