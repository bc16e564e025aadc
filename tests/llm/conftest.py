import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north oasis prairie quarry ridge shoal tundra upland valley wharf yonder zephyr".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


def edited(text, every, seed):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies."""
    out = [(i, prose(i, 5 + 17 * i % 200), ("en", "fr", None)[i % 3], ("web", "book", None)[i % 3]) for i in range(60)]
    base = prose(999, 150)
    out += [(100 + i, edited(base, 90, i), "en", "web") for i in range(25)]  # near copies of one another
    out += [(130 + i, base, "en", "web") for i in range(10)]
    out += [(140, None, None, None), (141, "", "en", "web"), (142, " \t\n\x0b\x0c\r ", "fr", "book"), (143, "one", "en", "web"), (144, "One", "en", "web"), (145, "Ünï ЖЖ 日本 \U0001f600 text", "fr", "web"), (146, prose(7, 30_000), "en", "web")]
    out += [(147, base, "en", "web")] * 2 + [(None, base, "en", "web"), (None, None, None, None)]
    out += [(150, "mail Ann.B@example.org or ann.b@example.org, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, call +44 20 7946 0958.", "en", "web")]
    return out


def write(folder, documents, labels=(), pages=()):
    folder.mkdir(parents=True, exist_ok=True)
    table = lambda rows, schema: pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    docs = table([(i, t, la, s, None if t is None else len(t), "x", 1) for i, t, la, s in documents], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("id", pa.string()), ("seq", pa.int32())]))
    pq.write_table(docs, folder / "documents.parquet", row_group_size=40)
    pq.write_table(table(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), folder / "labels.parquet")
    pq.write_table(table(pages, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])), folder / "pages.parquet")
    return str(folder)


PAGES = [(1, "http://www.Example.org:80/a?b=1#c", "<p>one</p>"), (2, "https://example.org/b", "<p>one</p>"), (3, None, None), (4, "not a url", ""), (None, "http://a.b/", "<p>one</p>"), (5, "http://a.b/", "ü"), (5, "http://a.b/", "ü"), (6, "http://example.org/a?b=1", "later")]


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    docs = rows()
    labels = [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (61, None, None), (5, 1, 0), (100, 1, 0), (101, 0, 1)]
    return write(tmp_path_factory.mktemp("edge") / "t", docs, labels, PAGES)


@pytest.fixture(scope="session")
def empty_tables(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty") / "t", [])
