import gzip
import hashlib
import random
from collections import Counter

import pytest

from lexicarta.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def rows():
    rng = random.Random(3)
    made = []
    for i in range(300):
        size = rng.choice([0, 5, 99, 100, 101, 3000])
        body = rng.choice(["a", "b", "é"]) * size if i % 3 else f"{i}" + "x" * size
        host = rng.choice(["www.example.com", "Example.com:8080", "a.b.example.org", "hot.example.net"])
        made.append((i, f"https://{host}/p/{i % 40}?q={i % 7}#f", body))
    made += [(None, None, "z" * 200), (400, None, "z" * 200), (None, "http://x/", "\r\n\r\n" * 60), (401, "bad url\r\n\t", "q")]
    made += [(7, "https://again.example/", made[7][2]), (402, "", None), (403, "mailto:x", "𝒳" * 30)]
    return made


def expected(made):
    groups = {}
    for page_id, _, body in made:
        if page_id is not None:
            groups[body or ""] = min(groups.get(body or "", page_id), page_id)
    out = Counter()
    for page_id, _, body in made:
        data = (body or "").encode()
        first = groups.get(body or "")
        again = len(data) >= 100 and first is not None and first != page_id
        out[(page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    return out


@pytest.fixture(scope="module")
def archived(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'x' AS payload", "1 AS file", "2 AS size").repartition(4)
    captures = warc.written(frame)
    return captures, warc.index(captures)


def test_pages_round_trip(archived):
    captures, indexed = archived
    got = warc.resolved(warc.read(captures), indexed).collect()
    assert Counter(tuple(r) for r in got) == expected(rows())


def test_archives_are_gzip_members_of_whole_records(archived):
    captures, _ = archived
    for file in {r.file for r in captures.collect()}:
        data = gzip.open(file.removeprefix("file://")).read()
        assert data.startswith(b"WARC/1.1\r\n")
        while data:
            record = warc.parse_record(data)
            head, _, rest = data.partition(b"\r\n\r\n")
            length = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert rest[length : length + 4] == b"\r\n\r\n"
            assert record["record_type"] in ("response", "revisit")
            data = rest[length + 4 :]


def test_lookup_by_url(spark, archived, monkeypatch):
    captures, _ = archived
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    indexed = warc.index(captures)
    assert indexed.agg({"lines": "sum"}).first()[0] == len(rows())
    asked = sorted({warc.url_key(u) for _, u, _ in rows()}) + ["com,absent)/", "zz", ""]
    keys = spark.createDataFrame([(k,) for k in asked], "key string")
    places = warc.located(indexed, keys)
    want = Counter((warc.re.sub(r"[\t\r\n]", "%20", warc.url_key(u)), p) for p, u, _ in rows())
    assert Counter((r.key, r.page_id) for r in places.collect()) == want
    assert Counter((r.page_id, r.url) for r in warc.ranges(places).collect()) == Counter(
        (p, None if u is None else warc._clean(u)) for p, u, _ in rows()
    )


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.Example.com/a/b?c=d#e", "com,example,www)/a/b?c=d"),
        ("http://example.com:80", "com,example)/"),
        ("http://u@example.com:8080/", "com,example:8080)/"),
        ("", ""),
        (None, ""),
        ("mailto:a@b.c", "a@b.c"),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_unfinished_archives_are_noticed():
    import io

    data = gzip.compress(b"WARC/1.1\r\n\r\n" * 1000)
    assert list(warc.members(io.BytesIO(data * 3), 50)) == [b"WARC/1.1\r\n\r\n" * 1000] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-12])))


def test_empty_table(spark):
    captures = warc.written(spark.createDataFrame([], SCHEMA))
    assert warc.resolved(warc.read(captures), warc.index(captures)).count() == 0
