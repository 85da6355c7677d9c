import pytest

from tessella.functions.articles import expand_clean
from tessella.functions.html import decode, listing_links, visible_text
from tessella.functions.stem import stem
from tessella.operators import ann
from tessella.sources import web


@pytest.mark.parametrize(("word", "out"), [("boataria", "boat"), ("nacionalidade", "nacional"), ("quilométricas", "quilométr"), ("jurisprudência", "jurisprudent"), ("rapidamente", "rapid"), ("sol", "sol"), ("", "")])
def test_stem(word, out):
    assert stem(word) == out


def test_expansion_limits():
    assert expand_clean("180.º, n.ºs 2 a 40") == ["180.º"] and expand_clean("1.º a 40.º") == ["1.º a 40.º"] and expand_clean("1.º, n.º 2-A e 3") == ["1.º, n.º 3"]


def test_pages():
    assert visible_text("<body><form>a<script>b</script></form> c  d <p>\n\n e</body>") == "c d\ne" and visible_text("") == ""
    assert decode(b"\xe7") == "ç" and decode("Á".encode()) == "Á"
    assert listing_links("<a>no</a><a href='x'>y</a>", "https://h.example") == []


def test_fetch_and_walk():
    waits, calls = [], []

    def opener(url):
        calls.append(url)
        if url.endswith("flaky") and calls.count(url) < 3:
            raise OSError
        if url.endswith("gone"):
            return 404, b""
        if url.endswith("busy"):
            return 503, b""
        more = {"https://h.example/1": "<a href='/2?Start=2'>seguinte</a>", "https://h.example/2?Start=2": "<a href='/1?Start=1'>anterior</a>"}
        return 200, ("<a href='/d/" + str(len(calls)) + "?OpenDocument'>d</a>" + more.get(url, "")).encode()

    assert web.fetch("flaky", opener, sleep=waits.append) is not None and waits == [1, 2]
    assert web.fetch("gone", opener, sleep=waits.append) is None and waits == [1, 2]
    assert web.fetch("busy", opener, sleep=waits.append) is None and waits == [1, 2, 1, 2, 4, 8]
    docs = list(web.walk("https://h.example/1", "https://h.example", opener))
    assert [k for k, _ in docs] == ["doc", "doc"]
    assert list(web.walk("gone", "https://h.example", opener)) == [("failed", "gone")]


def test_fetched(spark):
    df = spark.createDataFrame([("a",), ("gone",), (None,)], "url string")
    rows = {r.url: r.content for r in web.fetched(df, lambda u: (200, b"x") if u == "a" else (404, b"")).collect()}
    assert bytes(rows["a"]) == b"x" and rows["gone"] is None and rows[None] is None


def test_index_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    centres = ann.centroids(vectors, "embedding", 16)
    queries = vectors.where("vec_id % 100 = 0")
    exact = ann.search(ann.index(vectors, "embedding", centres[:1]), queries, "vec_id", "embedding", centres[:1], probes=1)
    got = ann.search(ann.index(vectors, "embedding", centres), queries, "vec_id", "embedding", centres, probes=12)
    assert exact.select("query", "vec_id").intersect(got.select("query", "vec_id")).count() >= 0.9 * exact.count()
    assert ann.index(vectors, "embedding", centres).count() == vectors.count()
