import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T


def one(spark, kind, value, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]




@pytest.mark.parametrize("value,want", [("Hello, World!", "hello-world"), ("  ", "source"), ("", "source"), (None, None), ("a" * 60, "a" * 48), ("-" * 9 + "b", "b"), ("x" * 47 + " y", "x" * 47 + "-")])
def test_slugify(spark, value, want):
    assert one(spark, "string", value, lambda X: T.slugify(X)) == want


@pytest.mark.parametrize("value,want", [("a\r\n# T x \r\n", "T x"), ("## no", "stem"), ("# ", ""), ("", "stem"), (" # late", "late")])
def test_title(spark, value, want):
    assert one(spark, "string", value, lambda X: T.title_of(X, F.lit("stem"))) == want


def test_tokens_are_ascii(spark):
    assert sorted(one(spark, "string", "Schön schön 12-a", lambda X: T.tokens(X))) == ["12", "a", "n", "sch"]


def test_rounding_is_half_even(spark):
    assert one(spark, "double", 0.0625, lambda X: T.round3(X)) == 0.062


@pytest.mark.parametrize("value,want", [("https://Youtu.be/abc", "youtube"), ("http://vimeo.com/1", "vimeo"), ("https://a.example", "url"), ("notes.md", "url"), ("ftp://youtube.com", "url")])
def test_classify(spark, value, want):
    assert one(spark, "string", value, lambda X: T.classify_target(X)) == want


@pytest.mark.parametrize("value,want", [("https://youtu.be/abc/x", "abc"), ("https://www.youtube.com/watch?v=Q1&t=2", "Q1"), ("https://youtube.com/shorts/zz", "zz"), ("https://youtube.com/", None)])
def test_youtube_id(spark, value, want):
    assert one(spark, "string", value, lambda X: T.youtube_id(X)) == want


def test_vimeo_id(spark):
    assert one(spark, "string", "https://vimeo.com/channels/9a/123/4", lambda X: T.vimeo_id(X)) == "123"


@pytest.mark.parametrize("value,want", [(0.9, "00:00:00"), (3661.5, "01:01:01"), (400000.0, "111:06:40")])
def test_clock(spark, value, want):
    assert one(spark, "double", value, lambda X: T.clock(X)) == want


@pytest.mark.parametrize("value,want", [("01:02:03.500", 3723.5), ("2:03,250", 123.25), ("nonsense", None)])
def test_vtt_seconds(spark, value, want):
    assert one(spark, "string", value, lambda X: T.vtt_seconds(X)) == want


@pytest.mark.parametrize("value,want", [("http://a.b/x).", "http://a.b/x"), ("http://a.b/(x)", "http://a.b/(x)"), ("http://a/(x))", "http://a/(x)"), ("...", ""), (None, None)])
def test_strip_url(spark, value, want):
    assert one(spark, "string", value, lambda X: T.strip_url(X)) == want


def test_blocks_and_prose(spark):
    assert one(spark, "string", "a\n \n\n> q\n\n- item\n", lambda X: T.blocks(X)) == ["a", "> q", "- item"]
    assert [one(spark, "string", v, lambda X: T.is_prose(X)) for v in ("> q", "<!-- c", "| r", "# h", "- item", "word")] == [False] * 4 + [True] * 2


def test_hint_section_and_directive(spark):
    loc = spark.createDataFrame([((None, 3, "", "a"),)], "x struct<url:string,page:int,timestamp:string,anchor:string>")
    assert loc.select(T.locator_hint(F.col("x")).alias("y")).first()["y"] == " p. 3"
    assert one(spark, "string", "on-call-API", lambda X: T.section_title(X)) == "On Call Api"
    assert [one(spark, "string", v, lambda X: T.directive_action(X)) for v in (" Stop Now ", "run automatically", "look at S01")] == ["stop", "automatic", "guidance"]


def test_decode_and_unescape(spark):
    df = spark.createDataFrame([(b"caf\xe9", "text/html; charset=latin-1"), (b"caf\xc3\xa9", None), (b'<meta charset="latin-1">\xe9', None), (None, None)], "b binary, k string")
    got = [r[0] for r in df.select(T.decode_page("b", "k")).collect()]
    assert got[0] == got[1] == "café" and got[2].endswith("é") and got[3] is None
    assert one(spark, "string", "a &amp; b&#33;", lambda X: T.unescape(X)) == "a & b!"
    assert one(spark, "string", "Prompt TOKEN limit", lambda X: T.context_exhausted(X)) is True


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from sparkloom.plans import lineage

    made = []
    conf = {"spark.checkpoint.dir": None}
    context = SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append, getConf=lambda: SimpleNamespace(get=conf.get))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: conf.get(k) or d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(session)
    conf["spark.checkpoint.dir"] = "/shared/x"
    assert lineage.ensure_checkpoint_dir(session) == "/shared/x" and made == ["/shared/x"]


def test_versions_are_told(capsys):
    from sparkloom import cli

    assert cli.main(["doctor", "anywhere"]) == 0 and '"pyspark": "4' in capsys.readouterr().out
