import duckdb

from tests.llm.cases import ROWS, clashing, empty, odd
from tideworks.llm import licences

MIT = "\n".join(["Copyright (c) 2024 x\n", *(licences.SENTENCES[k][0] + "." for k in ("MitGrant", "MitNotice", "AsIs", "NoLiability"))])


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [tuple(r)[1:] for r in licences.licence_rules(df).orderBy("doc_id").collect()]


def test_rules(spark):
    got = scan(spark, None, "", "words only. And more.", "Foo bar.\nReleased under the MIT License.", "x\nAll rights reserved.\n", MIT, MIT.replace(" and ", "\nand ").replace(" THE ", "\nTHE "), "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.")
    assert [g[2] for g in got] == ["", "", "", "MIT", "all-rights-reserved", "MIT", "MIT", "", "Apache-2.0,CC-BY-NC-4.0"]
    assert [g[4] for g in got] == ["none"] * 3 + ["licensed"] * 4 + ["partial", "licensed"]
    assert got[0][0] == 0 and got[2][0] == 2 and got[7][3] == 1


def test_longer_rules_consume_shorter_ones(spark):
    assert scan(spark, "MIT License\n" + MIT.partition("\n")[2])[0][1:4] == ("MitName/MitGrant/MitNotice/AsIs/NoLiability", "MIT", 0)


def test_every_known_sentence_is_recognised(spark):
    names = [n for n, texts in licences.SENTENCES.items() for _ in texts]
    got = scan(spark, *[t + "." for texts in licences.SENTENCES.values() for t in texts])
    assert [g[1] for g in got] == names


def test_equals_duckdb_and_keeps_rows(spark):
    docs = odd(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    rows = lambda x: sorted(tuple("" if str(v) in ("None", "nan", "<NA>") else str(v) for v in r) for r in x)
    assert rows(licences.licence_rules(docs).collect()) == rows(con.execute(licences.duckdb_sql()).df().itertuples(index=False))
    assert licences.licence_rules(docs).count() == len(ROWS) and licences.licence_rules(empty(spark)).count() == 0


def test_notices_of_one_line_above_wrapped_text(spark):
    """Each reading alone would lose what only the other knows."""
    wrapped = MIT.replace(" and ", "\nand ").replace(" THE ", "\nTHE ")
    got = scan(spark, f"SPDX-License-Identifier: MIT\n{wrapped.partition(chr(10) * 2)[2]}", f"Licensed under CC BY 4.0\nAll rights reserved\n\n{wrapped}", "Released under\nthe MIT\nLicense\nand so on ~ here | there")
    assert got[0][1:3] == ("MitRef/MitGrant/MitNotice/AsIs/NoLiability", "MIT")
    assert set(got[1][2].split(",")) >= {"MIT", "CC-BY-4.0", "all-rights-reserved"} and got[2][2] == "MIT"


def test_long_texts_and_clashing_columns(spark):
    long = "words of a line\n" * 200_000 + "Released under the MIT License.\n"
    assert scan(spark, long)[0][:3] == (200_001, "MitRef", "MIT")
    assert licences.licence_rules(clashing(spark, ["ids", "rest", "marked"])).count() == len(ROWS)
