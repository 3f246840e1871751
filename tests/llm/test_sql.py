"""The queries' own SQL against the queries, over small tables with nulls, empty, long and repeated texts."""

import random
from pathlib import Path

import duckdb
import pytest

from fespan.llm import licences, mixing, queries


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéüABC,.½") for _ in range(rng.randint(1, 14))) for _ in range(50)] + ["w" * 31, "v" * 32, "u" * 33, "é" * 90]
    shared = " ".join(rng.choice(vocab) for _ in range(70))
    made = ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "  "]) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    made += [t + shared for t in made[:8]] + [t + " end" for t in made[:20]] + made[5:9]
    files = sorted((Path(licences.__file__).parent / "licence_texts").iterdir())[::4]
    made += [f.read_text(encoding="utf-8") for f in files] + ["MIT License\n\nCopyright (c) 2020 A\n\n" + licences.KNOWN[0][1], licences.KNOWN[0][1].replace("license", "licence"), "x\nReleased under the MIT License.\r\nLicensed under CC BY 4.0."]
    made += ["Copyright Someone Else\nCopyright notice and terms\ncopyright by none\n// © me\nAll Rights Reserved.\r\n© 2020\nCopyright by Owner", None, "", " \n\t", "One", "one TWO", "a b c"]
    return made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, all_texts = str(tmp_path_factory.mktemp("tables")), texts()
    kinds = ["a", "b", None, "é", "B"]
    rows = [(i, t, ["en", None][i % 2], kinds[i * i % 5], len(t or "")) for i, t in enumerate(all_texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op1_substring", "op4_simhash", "op7_mixing", "op8_licences", "op10_suffix_array"])
def test_sql(spark, folder, monkeypatch, name):
    monkeypatch.setattr(mixing, "FAN", 8)  # more than one level of few rows
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder)
    found = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    expected = sorted(tuple(r[i] for i in at) for r in found.fetchall())
    got = sorted(tuple(r) for r in df.collect())
    assert [r[0] for r in got] == [r[0] for r in expected] and len(found.description) == len(df.columns)
    for a, b in zip(got, expected, strict=True):
        assert a == tuple(pytest.approx(y, rel=1e-9) if isinstance(y, float) else y for y in b)
