"""Registered queries over documents made of the test tables: sources, builders, text rules, extensions.

Bulk queries make an XML document of each customer, or of each part, and shred all of them. Those of
builders, which make one silo of their sources, take the tables of nations and regions.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import lzma
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import export, navigate
from .operators.paths import Options
from .plans.compile import attribute
from .plans.syntax import Registry, predicate
from .schema import TreeError
from .silo import Silo
from .sources.builder import Builder, Fixup, Rules, Source, shredded, spread
from .sources.content import Adapter, content_type
from .sources.dom import Node
from .store import shared_folder
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/silvestra-{uuid.uuid4().hex}"


# documents of customers
def _xml_of_customer() -> Column:
    k = F.col("c_custkey").cast("string")
    vip = F.when(F.col("c_custkey") % 3 == 0, F.lit(' vip="yes"')).otherwise(F.lit(""))
    return F.concat(
        F.lit('<?xml version="1.0"?><customer key="'), k, F.lit('"'), vip, F.lit("><name>"), F.col("c_name"), F.lit("</name><note>first "), k, F.lit("<b>bold "), k, F.lit("</b> tail "), k, F.lit("</note><lines>one "), k, F.lit("\n two "), k,
        F.lit('\n\n\nthree</lines><padded>  wide </padded><blank>   </blank><code><![CDATA[a < b & c]]></code><say xml:lang="de">Tag '), k, F.lit('</say><say>day '), k, F.lit('</say><say xml:lang="fr">jour '), k, F.lit("</say></customer>"),
    )


def _customers(spark: SparkSession, d: str, rules: Rules | None = None, adapters: tuple[Adapter, ...] = (), fixups: tuple[Fixup, ...] = (), content: Column | None = None, options: Options | None = None) -> Silo:
    docs = spread(_table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("silo_id"), (content if content is not None else _xml_of_customer()).alias("content"))
    return Silo(shredded(docs, rules, adapters, fixups), options=options)


def _of_customer(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(F.col("silo_id").cast("long").alias("k"), *[c.alias(n) for n, c in columns.items()])


def _with(xpath: str, rules: Rules | None = None, fixups: tuple[Fixup, ...] = (), content: Callable[[], Column] | None = None, **columns: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        silo = _customers(spark, d, rules, (), fixups, content() if content else None)
        return _of_customer(silo.query(xpath), **{n: F.expr(c) for n, c in columns.items()})

    return run


def _invalid(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document is torn; the rule leaves it out."""
    torn = F.when(F.col("c_custkey") % 7 == 0, F.substring(_xml_of_customer(), 1, 60)).otherwise(_xml_of_customer())
    return _of_customer(_customers(spark, d, Rules(ignore_invalid=True), content=torn).query("customer/name"), name=F.col("text"))


def _xz(raw: bytes) -> bytes:
    """By a dictionary no larger than the document: one of 8 MB takes longer to set up than all the rest."""
    return lzma.compress(raw, filters=[{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": max(4096, len(raw))}])


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Each document compressed three ways, one in another; content types show how to undo it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdCompressor()
        for batch in batches:
            wrap = [gzip.compress(zstd.compress(_xz(x.as_py()))) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("silo_id"), pa.array(wrap, pa.binary())], ["silo_id", "content"])

    docs = spread(_table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").cast("string").alias("silo_id"), _xml_of_customer().cast("binary").alias("content"))
    return _of_customer(Silo(shredded(docs.mapInArrow(run, "silo_id string, content binary"))).query("customer/name"), name=F.col("text"))


_NAMES = ("a.xml", "b.desktop", "c.quirk", "d.zst", "e.bin")
_KINDS = ("application/xml", "application/x-desktop", "text/x-quirk", "application/zstd", "application/octet-stream")


def _content_types(spark: SparkSession, d: str) -> DataFrame:
    """By name alone for text that tells nothing, by the first bytes for documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [(content_type(n.as_py(), b"nothing"), content_type("x.bin", x.as_py())) for n, x in zip(batch.column("name"), batch.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([x[0] for x in kinds], pa.string()), pa.array([x[1] for x in kinds], pa.string())], ["k", "by_name", "by_bytes"])

    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return spread(_table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("k"), name.alias("name"), _xml_of_customer().cast("binary").alias("content")).mapInArrow(run, "k long, by_name string, by_bytes string")


def _adapter_context(spark: SparkSession, d: str) -> DataFrame:
    """The adapter writes down what it is told of each page."""
    told = Adapter(("text/x-quirk",), lambda c: f'<page name="{c.name}" kind="{c.kind}" bytes="{len(c.raw)}"/>', True)
    docs = _table(spark, d, "pages").select(F.col("page_id").cast("string").alias("silo_id"), F.concat(F.lit("p"), "page_id", F.lit(".quirk")).alias("name"), F.col("html").alias("content"))
    rows = Silo(shredded(docs, None, (told,))).query("page")
    return rows.select(F.col("silo_id").cast("long").alias("page_id"), attribute("name").alias("name"), attribute("kind").alias("kind"), attribute("bytes").cast("long").alias("bytes"))


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    """A fixup that marks and one that hides, in every document."""

    def mark(n: Node) -> None:
        if n.element == "customer":
            n.set_attr("size", "small").set_attr("size", "large" if n.attr_as_uint("key") % 2 else "even").remove_attr("vip")

    def hide(n: Node) -> None:
        n.ignore = n.ignore or n.element == "say"

    rows = _customers(spark, d, None, (), (Fixup("mark", mark, 1), Fixup("hide", hide))).nodes
    return _of_customer(rows.groupBy("silo_id").agg(F.max(attribute("size")).alias("size"), F.max(attribute("vip")).alias("vip"), F.count("*").alias("n")), size=F.col("size"), vip=F.col("vip"), n=F.col("n"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two roots, and a document type without effect."""
    k = F.col("c_custkey").cast("string")
    content = F.concat(F.lit("<!DOCTYPE tag [<!ENTITY e 'x'>]><tag>a"), k, F.lit("</tag><tag>b"), k, F.lit("</tag>"))
    return _of_customer(navigate.roots(_customers(spark, d, content=content).nodes), text=F.col("text"), pos=F.col("sib_pos"))


def _tokenised(xpath: str, **columns: str) -> Query:
    """Names of parts, stored with their tokens."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = spread(_table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("silo_id"), F.concat(F.lit("<part><name>"), "p_name", F.lit("</name><many>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: F.concat(F.lit("word"), x)), " "), F.lit("</many></part>")).alias("content"))
        return _of_customer(Silo(shredded(docs, Rules(tokenize=True))).query(xpath), **{n: F.expr(c) for n, c in columns.items()})

    return run


def _parts_with(registry: Registry | None, xpath: str, **options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .queries import silo

        s = Silo(silo(spark, d, "P").nodes, options=Options(**({"registry": registry} if registry else {}), **options))
        return s.query(xpath).select(attribute("key").alias("k"))

    return run


def _extended() -> Registry:
    r = Registry()
    r.add_function("reversed", 1, lambda a: ("text", F.reverse(a[1])))
    r.add_operator("<=>", "eq")
    r.add_rewrite("TEXT,TEXT,FUNC:ne", lambda e: predicate("@size>40")[0])
    r.add_shorthand(lambda t: predicate("@size")[0].args[0] if t == "#size" else None)
    return r


def _helpers(rows: DataFrame, made: Callable[[str], tuple[str, int]], column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [made(x.as_py()) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["k", "text", "n"])

    return rows.mapInArrow(run, "k long, text string, n long")


# one silo of nations and regions
def _rows(spark: SparkSession, d: str, name: str, key: str) -> list:
    """A small dimension, which builders take as documents given by the program."""
    return _table(spark, d, name).orderBy(key).collect()


def _nation_docs(spark: SparkSession, d: str) -> list[tuple[int, str]]:
    """A document of each region, with its nations."""
    nations: dict[int, str] = {}
    for r in _rows(spark, d, "nation", "n_nationkey"):
        nations[r["n_regionkey"]] = nations.get(r["n_regionkey"], "") + f'<nation key="{r["n_nationkey"]}">{r["n_name"]}</nation>'
    return [(r["r_regionkey"], f'<region name="{r["r_name"]}">{nations.get(r["r_regionkey"], "")}</region>') for r in _rows(spark, d, "region", "r_regionkey")]


def _builder(spark: SparkSession, d: str, change: Callable[[Source, int], Source] | None = None) -> Builder:
    """One source for each region, text and bytes by turns."""
    out = Builder(spark, "regions")
    for k, xml in _nation_docs(spark, d):
        source = Source.of_text(xml) if k % 2 else Source.of_bytes(xml.encode())
        out.add_source(change(source, k) if change else source)
    return out


def _names(silo: Silo, xpath: str = "region/nation") -> DataFrame:
    return silo.query(xpath).select(F.col("text").alias("nm"))


def _xml_string(spark: SparkSession, d: str) -> DataFrame:
    return _names(Silo.from_xml(spark, "<regions>" + "".join(x for _, x in _nation_docs(spark, d)) + "</regions>"), "regions/region/nation")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    silo = Silo(_builder(spark, d).compiled())
    return navigate.parents(silo.nodes, silo.query("region/nation")).select(attribute("name").alias("region"))


def _files(codec: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        folder = _new_folder(spark)
        xml = F.concat(F.lit('<?xml version="1.0"?><nation key="'), "n_nationkey", F.lit('">'), "n_name", F.lit("</nation>"))
        _table(spark, d, "nation").select(xml.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").option("compression", codec).text(folder)
        return _names(Silo(Builder(spark).add_source(Source.of_file(f"{folder}/k=*/part-*")).compiled()), "nation")

    return run


def _prefixed(spark: SparkSession, d: str) -> DataFrame:
    silo = Silo(_builder(spark, d, lambda s, k: s.set_prefix("even" if k % 2 == 0 else "odd")).compiled())
    return silo.query_many(["even", "odd", "even/region/nation", "odd/region/nation"]).groupBy("query").agg(F.count("*").alias("n"))


def _informed(spark: SparkSession, d: str) -> DataFrame:
    def info(source: Source, k: int) -> Source:
        node = Node("info")
        node.insert("from", f"region {k}")
        return source.set_info(node)

    silo = Silo(_builder(spark, d, info).compiled())
    return silo.query("region/info/from").select(F.col("text").alias("origin"))


def _saved(spark: SparkSession, d: str) -> DataFrame:
    from .queries import silo

    saved = Silo(silo(spark, d, "W").nodes, "w").save(_new_folder(spark))
    return Silo.load(spark, saved.path).query("regions/region/nation/customer").select(attribute("key").alias("k"))


def _ensured(spark: SparkSession, d: str) -> DataFrame:
    """An unchanged builder gets the saved silo, a changed one a new silo, and the first is outdated then."""
    folder = _new_folder(spark)
    first = Silo.ensure(_builder(spark, d), folder)
    again = Silo.ensure(_builder(spark, d), folder)
    kept = again.guid == first.guid and first.is_valid()
    new = Silo.ensure(_builder(spark, d).add_source(Source.of_text("<region><nation>NOWHERE</nation></region>")), folder)
    return _names(new).select("nm", F.lit(kept).alias("kept"), F.lit(first.is_valid()).alias("still"))


def _guid(spark: SparkSession, d: str) -> DataFrame:
    xml = "".join(r["n_name"] for r in _rows(spark, d, "nation", "n_nationkey"))
    return spark.createDataFrame([(Builder(spark).add_source(Source.of_text(f"<n>{xml}</n>")).append_guid("more").guid(),)], "guid string")


def _by_hand(spark: SparkSession, d: str) -> DataFrame:
    """A tree made, sorted and pruned by its methods, then exported and compiled."""
    top = Node("nations")
    for r in _rows(spark, d, "nation", "n_nationkey"):
        n = top.insert("nation", r["n_name"], key=str(r["n_nationkey"]), old="x")
        n.remove_attr("old").add_token("one").set_tail(None)
        n.insert("drop").unlink()
    top.sort_children(lambda n: n.attr_as_uint("key"), reverse=True)
    assert top.first() is top.children[0] and top.child("nation", top.last().text) is not None
    inner = sum(1 for _ in top.walk(only="leaves"))
    compiled = Silo(Builder(spark).add_node(top).compiled())
    return spark.createDataFrame([(top.export(), inner, compiled.export_text(), compiled.size(), compiled.is_empty())], "xml string, leaves long, compiled string, size long, empty boolean")


def _slashed(spark: SparkSession, d: str) -> DataFrame:
    top = Node("nations")
    for r in _rows(spark, d, "nation", "n_nationkey"):
        top.insert("a/b" if r["n_nationkey"] % 2 else "a", r["n_name"]).insert("b", "inner")
    return _names(Silo(Builder(spark).add_node(top).compiled()), f"nations/{T.escaped('a/b')}")


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    xml = "<regions>" + "".join(f'<region key="{r["r_regionkey"]}">{r["r_name"]}</region>' for r in _rows(spark, d, "region", "r_regionkey")) + "</regions>"
    return spark.createDataFrame([(x,) for x in Silo.from_xml(spark, xml).dump().split("\n")], "line string")


def _command_line(spark: SparkSession, d: str) -> DataFrame:
    from .__main__ import main

    saved, said = Silo(_builder(spark, d).compiled(), "r").save(_new_folder(spark)), io.StringIO()
    with contextlib.redirect_stdout(said):
        code = main(["query", saved.path, "region/nation"], spark)
    return spark.createDataFrame([(x, code) for x in said.getvalue().splitlines()], "line string, code int")


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    silo = Silo(_builder(spark, d).compiled())
    row = (silo.first_text("region/nation"), silo.first_attr("region", "name"), silo.first_attr_as_uint("region/nation", "key"), silo.first_text_as_uint("region/nation"), silo.first_export("region/nation"), silo.first("region/none") is None)
    return spark.createDataFrame([row], "nm string, region string, key long, number long, xml string, none boolean")


def _folds(spark: SparkSession, d: str) -> DataFrame:
    """Of each region's document, the names in order with marks before and after."""
    docs = spark.createDataFrame([(str(k), x) for k, x in _nation_docs(spark, d)], "silo_id string, content string")
    nodes = shredded(docs)
    made = export.folded(nodes, navigate.roots(nodes), lambda n, out: out.append(f"[{n['attrs'].get('name') or n['text']}"), lambda n, out: out.append("]"))
    return made.select(F.col("silo_id").cast("int").alias("k"), F.col("result"))


def _node_data(spark: SparkSession, d: str) -> DataFrame:
    from .queries import silo

    s, parts = Silo(silo(spark, d, "P").nodes), silo(spark, d, "P").query("parts/part")
    s.set_data("band", s.query("parts/part[@size>25]"), F.lit("large")).set_data("band", s.query("parts/part[@size>45]"), F.lit("huge"))
    return s.data("band", parts).select(attribute("key").alias("k"), F.col("data").alias("band"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """What reading and compiling says of wrong predicates."""
    from .queries import silo

    s, out = silo(spark, d, "W"), []
    for text in ("text()", "'a'='b'", "contains('a')", "('a','b')", "1=2", "@key and @name", "nothing()", "last()"):
        try:
            s.query(f"regions/region[{text}]", check=False)
            out.append((text, "fine"))
        except TreeError as e:
            out.append((text, e.code))
    return spark.createDataFrame(out, "predicate string, code string")


def _joined_paths(spark: SparkSession, d: str) -> DataFrame:
    from .queries import silo

    s = silo(spark, d, "P")
    return s.query(T.union_of("parts/part[@size=1]", "", "parts/part[@size=2]", "parts/part[@size=1]")).select(attribute("key").alias("k"))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """The nations in the order of the document, numbered as they come."""
    from .queries import silo

    rows = silo(spark, d, "W").query("regions/region/nation", ordered=True).select(attribute("name").alias("nm")).collect()
    return spark.createDataFrame([(k, r["nm"]) for k, r in enumerate(rows, 1)], "place long, nm string")


def _watched(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files by nation; then those of region 1 change and those of region 2 go."""
    folder, nodes = _new_folder(spark), _new_folder(spark)
    rows = _table(spark, d, "nation")

    def put(some: DataFrame, text: Column) -> None:
        made = some.select(F.concat(F.lit("<nation>"), text, F.lit("</nation>")).alias("value"), F.col("n_nationkey").alias("k"))
        made.write.mode("append").partitionBy("k").text(folder)

    def drop(some: DataFrame) -> None:
        for r in some.select("n_nationkey").collect():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/k={r['n_nationkey']}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    put(rows, F.col("n_name"))
    first, again = watch.refreshed(spark, folder, nodes), watch.refreshed(spark, folder, nodes)
    drop(rows.where("n_regionkey in (1, 2)"))
    put(rows.where("n_regionkey = 1"), F.concat(F.lit("NEW "), "n_name"))
    watch.refreshed(spark, folder, nodes)
    return _names(Silo(watch.latest(spark, nodes)), "nation").select("nm", F.lit(first).cast("long").alias("first"), F.lit(again).cast("long").alias("again"))


def _validity(spark: SparkSession, d: str) -> DataFrame:
    silo = Silo(_builder(spark, d).compiled(), "r").save(_new_folder(spark))
    before = silo.is_valid()
    return spark.createDataFrame([(before, silo.invalidate().is_valid(), Silo.load(spark, silo.path).is_valid())], "before boolean, after boolean, again boolean")


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """Flags, the cache of parsed queries, and queries as text."""
    from .queries import silo

    s = silo(spark, d, "W")
    q = s.prepare("regions/region[@name='ASIA']/nation[2]")
    never = s.prepare("regions/region[1=2]", optimize=False)
    back = s.run(s.prepare("regions/region", reverse=True, limit=2)).collect()
    return spark.createDataFrame([(str(q), s.prepare(q.xpath) is q, s.run(never).count(), "".join(x["attrs"][1]["value"] for x in back))], "postfix string, cached boolean, never long, back string")


def _index(spark: SparkSession, d: str) -> DataFrame:
    """An index of types: literals and bound texts must be in it; what isn't is an error."""
    from .queries import silo

    s = Silo(silo(spark, d, "P").nodes, options=Options(strict_index=True)).build_index("parts/part", "type")
    codes = []
    for xpath, binds in (("parts/part[@type=$'NOTHING']", ()), ("parts/part[@type=?]", ("NOTHING",))):
        try:
            codes.append(str(s.run(xpath, *binds).count()))
        except TreeError as e:
            codes.append(e.code)
    rows = s.run("parts/part[attr($'type')=$'PROMO']").unionByName(s.run("parts/part[@type=?]", "ECONOMY"))
    return rows.select(attribute("key").alias("k"), F.lit(",".join(codes)).alias("codes"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    """Nodes kept in memory; a node found in two ways is one by its ids."""
    silo = Silo(_builder(spark, d).compiled()).cached()
    one, two = silo.query("region/nation"), silo.query("*/nation[@key]")
    return one.join(two, ["silo_id", "node_id"], "left_semi").select(F.col("text").alias("nm"))


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    from .queries import silo

    s = Silo(silo(spark, d, "W").nodes)
    s.profile = []
    for xpath in ("regions/region", "regions/region/nation"):
        s.query(xpath)
    return spark.createDataFrame([(what, took > 0) for what, took in s.profile], "query string, timed boolean")


def _world_search(spark: SparkSession, d: str) -> DataFrame:
    """Null and empty texts in searches: no match, and no error."""
    from .queries import silo

    s = silo(spark, d, "W")
    counts = [s.query("regions/region[text()~='a']").count(), s.run("regions/region[@name~=?]", "").count(), s.query("regions/region[@nope~='a']").count()]
    return spark.createDataFrame([tuple(counts)], "in_null long, for_empty long, in_missing long")


_K = "c_custkey AS k"
_ONE = "SELECT CAST(p_partkey AS VARCHAR) k FROM part WHERE "
_NAMES_SQL = "SELECT n_name nm FROM nation"
_KIND = "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_KINDS)) + " END"
#: name: (query, SQL)
ALL: dict[str, tuple[Query, str]] = {
    "q43_xml_string": (_xml_string, _NAMES_SQL),
    "q44_text_and_bytes_sources": (_sources, "SELECT r_name region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "q45_files": (_files("none"), _NAMES_SQL),
    "q46_compressed_files": (_files("gzip"), _NAMES_SQL),
    "q47_compressed_documents": (_wrapped, f"SELECT {_K}, c_name AS name FROM customer"),
    "q48_content_types": (_content_types, f"SELECT {_K}, {_KIND} AS by_name, 'application/xml' AS by_bytes FROM customer"),
    "q49_adapter_context": (_adapter_context, "SELECT page_id, 'p' || page_id || '.quirk' AS name, 'text/x-quirk' AS kind, CAST(strlen(html) AS BIGINT) AS bytes FROM pages WHERE trim(html) <> ''"),
    "q50_prefix": (_prefixed, "SELECT p AS query, CAST(1 AS BIGINT) n FROM (VALUES ('even'), ('odd')) t(p) UNION ALL SELECT CASE n_regionkey % 2 WHEN 0 THEN 'even/region/nation' ELSE 'odd/region/nation' END, count(*) FROM nation GROUP BY 1"),
    "q51_source_info": (_informed, "SELECT 'region ' || r_regionkey AS origin FROM region"),
    "q52_ignore_invalid": (_invalid, f"SELECT {_K}, c_name AS name FROM customer WHERE c_custkey % 7 <> 0"),
    "q53_saved_and_loaded": (_saved, "SELECT CAST(c_custkey AS VARCHAR) k FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "q54_ensured": (_ensured, f"SELECT nm, true AS kept, false AS still FROM ({_NAMES_SQL} UNION ALL SELECT 'NOWHERE')"),
    "q55_guid": (_guid, "SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS guid FROM (SELECT sha1('1&more&' || sha1('<n>' || string_agg(n_name, '' ORDER BY n_nationkey) || '</n>')) h FROM nation)"),
    "q56_tree_by_hand": (_by_hand, "SELECT x AS xml, n AS leaves, x AS compiled, n + 1 AS size, false AS empty FROM (SELECT '<nations>' || string_agg('<nation key=\"' || n_nationkey || '\">' || n_name || '</nation>', '' ORDER BY n_nationkey DESC) || '</nations>' x, count(*) n FROM nation)"),
    "q57_dump": (_dumped, "SELECT line FROM (SELECT 'silo:     1 regions ' AS line UNION ALL SELECT 'silo:' || lpad(CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS VARCHAR), 6, ' ') || '   region @key=' || r_regionkey || ' ''' || r_name || '''' FROM region)"),
    "q58_command_line": (_command_line, "SELECT '<nation key=\"' || n_nationkey || '\">' || n_name || '</nation>' AS line, CAST(0 AS INT) AS code FROM nation"),
    "q59_slash_in_name": (_slashed, f"{_NAMES_SQL} WHERE n_nationkey % 2 = 1"),
    "q60_first_of_each": (_firsts, "SELECT n_name nm, r_name region, CAST(n_nationkey AS BIGINT) AS key, CAST(0 AS BIGINT) AS number, '<nation key=\"' || n_nationkey || '\">' || n_name || '</nation>' AS xml, true AS none FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_regionkey, n_nationkey LIMIT 1"),
    "q61_fold": (_folds, "SELECT r_regionkey AS k, '[' || r_name || string_agg('[' || n_name || ']', '' ORDER BY n_nationkey) || ']' AS result FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"),
    "q62_node_data": (_node_data, "SELECT CAST(p_partkey AS VARCHAR) k, CASE WHEN p_size > 45 THEN 'huge' WHEN p_size > 25 THEN 'large' END AS band FROM part"),
    "q63_some_have_attr": (_with("customer[@vip]/name", name="text"), f"SELECT {_K}, c_name AS name FROM customer WHERE c_custkey % 3 = 0"),
    "q64_not_attr": (_with("customer[not(@vip)]/name", name="text"), f"SELECT {_K}, c_name AS name FROM customer WHERE c_custkey % 3 <> 0"),
    "q65_tail": (_with("customer/note/b[ends-with(tail(),'7')]", tail="tail"), f"SELECT {_K}, ' tail ' || c_custkey AS tail FROM customer WHERE c_custkey % 10 = 7"),
    "q66_folded_literals": (_parts_with(None, "parts/part[@type=upper-case(lower-case('Promo'))]"), _ONE + "p_type = 'PROMO'"),
    "q67_last_predicate": (_parts_with(None, "parts/part[@size>=40][@type='ECONOMY']"), _ONE + "p_type = 'ECONOMY'"),
    "q68_all_predicates": (_parts_with(None, "parts/part[@size>=40][@type='ECONOMY']", predicates="all"), _ONE + "p_size >= 40 AND p_type = 'ECONOMY'"),
    "q69_result_check": (_checked, "SELECT * FROM (VALUES ('text()', 'invalid'), ('''a''=''b''', 'always_false'), ('contains(''a'')', 'invalid'), ('(''a'',''b'')', 'invalid'), ('1=2', 'always_false'), ('@key and @name', 'invalid'), ('nothing()', 'invalid'), ('last()', 'fine')) t(predicate, code)"),
    "q70_string_replace": (lambda s, d: _helpers(_table(s, d, "documents").select(F.col("doc_id").alias("k"), "text"), lambda x: T.replaced(x or "", "the", "ONE"), "text"), "SELECT doc_id AS k, replace(text, 'the', 'ONE') AS text, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents"),
    "q71_append_union": (_joined_paths, "SELECT CAST(p_partkey AS VARCHAR) k FROM part JOIN (VALUES (1), (2), (1)) v(x) ON p_size = x"),
    "q72_escape": (lambda s, d: _helpers(_table(s, d, "pages").select(F.col("page_id").alias("k"), "url"), lambda x: (T.escaped(x or ""), len(x or "")), "url"), "SELECT page_id AS k, replace(url, '/', '\\/') AS text, CAST(length(url) AS BIGINT) AS n FROM pages"),
    "q73_blank_text_is_none": (_with("customer/blank", text="text"), f"SELECT {_K}, CAST(NULL AS VARCHAR) AS text FROM customer"),
    "q74_tokens": (_tokenised("part/name", tokens="array_join(tokens, ' ')", flag="is_tokenized"), "SELECT CAST(p_partkey AS BIGINT) k, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: strlen(x) >= 3), ' ') AS tokens, true AS flag FROM part"),
    "q75_token_search": (_tokenised("part/name[text()~='wid']", nm="text"), "SELECT CAST(p_partkey AS BIGINT) k, p_name AS nm FROM part WHERE regexp_matches(p_name, '(^| )wid')"),
    "q76_thirty_two_tokens": (_tokenised("part/many", n="size(tokens)", last="element_at(tokens, -1)"), "SELECT CAST(p_partkey AS BIGINT) k, CAST(32 AS INT) AS n, 'word32' AS last FROM part"),
    "q77_search_of_nothing": (_world_search, "SELECT CAST(0 AS BIGINT) AS in_null, CAST(0 AS BIGINT) AS for_empty, CAST(0 AS BIGINT) AS in_missing"),
    "q78_result_order": (_ordered, "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place, n_name nm FROM nation"),
    "q79_watched_folder": (_watched, "SELECT CASE n_regionkey WHEN 1 THEN 'NEW ' || n_name ELSE n_name END AS nm, (SELECT count(*) FROM nation) AS first, CAST(0 AS BIGINT) AS again FROM nation WHERE n_regionkey <> 2"),
    "q80_validity": (_validity, "SELECT true AS before, false AS after, true AS again"),
    "q81_user_function": (_parts_with(_extended(), "parts/part[reversed(@type)='OMORP']"), _ONE + "p_type = 'PROMO'"),
    "q82_user_operator": (_parts_with(_extended(), "parts/part[@type<=>'PROMO']"), _ONE + "p_type = 'PROMO'"),
    "q83_user_rewrite": (_parts_with(_extended(), "parts/part['a'!='b']"), _ONE + "p_size > 40"),
    "q84_user_shorthand": (_parts_with(_extended(), "parts/part[#size<5]"), _ONE + "p_size < 5"),
    "q85_fixups": (_fixed, f"SELECT {_K}, CASE c_custkey % 2 WHEN 1 THEN 'large' ELSE 'even' END AS size, CAST(NULL AS VARCHAR) AS vip, CAST(8 AS BIGINT) AS n FROM customer"),
    "q86_prepared_queries": (_prepared, "SELECT 'regions/region[''name'',attr(),''ASIA'',eq()]/nation[2,position(),eq()]' AS postfix, true AS cached, CAST(0 AS BIGINT) AS never, string_agg(r_name, '' ORDER BY r_regionkey DESC) AS back FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 2)"),
    "q87_index": (_index, "SELECT CAST(p_partkey AS VARCHAR) k, 'invalid_argument,invalid_argument' AS codes FROM part WHERE p_type IN ('PROMO', 'ECONOMY')"),
    "q88_cached_nodes": (_cached, _NAMES_SQL),
    "q89_profile": (_profiled, "SELECT * FROM (VALUES ('regions/region', true), ('regions/region/nation', true)) t(query, timed)"),
    "q90_text_and_tail": (_with("customer/note/b", text="text", tail="tail"), f"SELECT {_K}, 'bold ' || c_custkey AS text, ' tail ' || c_custkey AS tail FROM customer"),
    "q91_text_before_children": (_with("customer/note", text="text"), f"SELECT {_K}, 'first ' || c_custkey AS text FROM customer"),
    "q92_repaired_text": (_with("customer/lines", text="text"), f"SELECT {_K}, 'one ' || c_custkey || ' two ' || c_custkey || chr(10) || chr(10) || 'three' AS text FROM customer"),
    "q93_literal_text": (_with("customer/lines", Rules(literal=True), text="text"), f"SELECT {_K}, 'one ' || c_custkey || chr(10) || ' two ' || c_custkey || chr(10) || chr(10) || chr(10) || 'three' AS text FROM customer"),
    "q94_stripped_text": (_with("customer/padded", Rules(strip=True), text="text"), f"SELECT {_K}, 'wide' AS text FROM customer"),
    "q95_unstripped_text": (_with("customer/padded", text="text"), f"SELECT {_K}, '  wide ' AS text FROM customer"),
    "q96_character_data": (_with("customer/code", text="text"), f"SELECT {_K}, 'a < b & c' AS text FROM customer"),
    "q97_native_languages": (_with("customer/say", Rules(native_langs=True, locales=("de", "C")), text="text"), "SELECT c_custkey AS k, w || c_custkey AS text FROM customer, (VALUES ('Tag '), ('day ')) t(w)"),
    "q98_one_language": (_with("customer/say", Rules(single_lang=True, locales=("fr", "de", "C")), text="text"), f"SELECT {_K}, 'jour ' || c_custkey AS text FROM customer"),
    "q99_several_roots": (_roots, "SELECT c_custkey AS k, w || c_custkey AS text, CAST(p AS BIGINT) AS pos FROM customer, (VALUES ('a', 1), ('b', 2)) t(w, p)"),

    "q100_number_of_junk": (_with("customer[number(@vip)!=5]", content=lambda: F.concat(F.lit('<customer vip="'), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.lit("junk")), F.lit('"/>')), vip="silo_id"), "SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS vip FROM customer WHERE c_custkey % 2 = 0"),
}
