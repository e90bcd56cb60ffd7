import random

import pytest

WORDS = "the of and thing erat onth wh re ing hand tion ble ou st ly an in he ers edon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "th"]) for _ in range(n))


def documents():
    """Rows with copies, near copies, odd and missing values."""
    rng = random.Random(3)
    rows = []
    base = [prose(rng, 120) for _ in range(6)]
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        text = prose(rng, rng.choice([30, 80, 200])) if lang == "en" else " ".join("é" + w[::-1] + "ç" for w in prose(rng, 60).split())
        rows.append((i, text + "\n" + text[:40], lang, f"s{i % 5}", len(text)))
    for k, text in enumerate(base):
        words = text.split()
        for j in range(4):
            near = list(words)
            near[10 * j + 3] = "changed" + str(j)
            rows.append((100 + 10 * k + j, " ".join(near) if j else text.upper(), "en", "s0", len(text)))
    rows += [(200, None, "en", "s1", 0), (201, "", "fr", None, 0), (202, " \t\n ", None, "s2", 4), (203, "1234 !!", "en", "s3", 7), (204, "one two three", "en", "s3", 13), (205, "ONE two\nthree", "en", "s3", 13)]
    rows += [(206, "a b c d e f g", "en", "s4", 13), (207, "a b c d e f g h", "en", "s4", 15), (208, "x" * 5000 + " " + "y z " * 3000, "en", "s1", 17001), (209, "same same same same same same same same same same same same", "en", "s1", 59), (206, "a b c d e f g", "en", "s4", 13)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folder of small tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows if r[0] < 60], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    talk = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "back\\slash <| \\| x"), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "ok\n"), (3, 0, "assistant", "<<|im_start|>"), (None, 0, "user", "nobody"), (2, 2, "assistant", "ok\n")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(1, "the of AND thing"), (2, None), (3, "one TWO, three! x9"), (3, "two"), (None, "ers"), (4, "zzz")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder
