"""Graphs as JSON, GraphML, graph-database CSV, Turtle, Cypher and a web page."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, safe_id, xml_escape
from ..operators.graph import legend, stats, viewer_edges, viewer_nodes

EVIDENCE = 200


def entries(col: str = "properties") -> Column:
    """Properties as (key, value) by key; values may be of a type that has no order."""
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.array_sort(F.map_entries(col), by_key)


def props_json(col: str = "properties") -> Column:
    """Properties as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(entries(col)))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, line)."""
    d = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), xml_escape(value), F.lit("</data>"))
    keys = [("node", "label"), ("node", "type"), ("node", "description"), ("node", "properties"), ("edge", "etype"), ("edge", "elabel"), ("edge", "evidence"), ("edge", "eprops")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for f, k in keys), '<graph id="G" edgedefault="directed">']
    fixed = nodes.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "part int, ord long, line string")
    n = nodes.select(F.lit(1).alias("part"), "ord", F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), d("label", _text("label")), d("type", _text("type")), d("description", _text("description")), d("properties", props_json()), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), "ord", F.concat(F.lit('<edge id="e'), F.col("ord").cast("string"), F.lit('" source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('">'), d("etype", _text("type")), d("elabel", _text("label")), d("evidence", _text("evidence")), d("eprops", props_json()), F.lit("</edge>")).alias("line"))
    return fixed.unionByName(n).unionByName(e)


def node_columns() -> dict[str, Column]:
    return {":ID": F.col("id"), "label:string": F.col("label"), ":LABEL": F.col("type"), "description:string": F.col("description"), "properties:string": props_json()}


def edge_columns() -> dict[str, Column]:
    return {":START_ID": F.col("source"), ":END_ID": F.col("target"), ":TYPE": F.col("type"), "label:string": F.col("label"), "evidence:string": F.col("evidence"), "properties:string": props_json()}


def csv_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[c.alias(name) for name, c in node_columns().items()])


def csv_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*[c.alias(name) for name, c in edge_columns().items()])


def csv_lines(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(part, ord, line) of a table with ``ord``: names, then rows; fields are quoted where they must be."""
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    head = table.sparkSession.createDataFrame([(0, 0, ",".join(columns))], "part int, ord long, line string")
    rows = F.concat_ws(",", *[cell(F.coalesce(c.cast("string"), F.lit(""))) for c in columns.values()])
    return head.unionByName(table.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), rows.alias("line")))


def turtle_lines(nodes: DataFrame, edges: DataFrame, base: str = "http://example.org/graph#") -> DataFrame:
    lit_ = lambda c: F.concat(F.lit('"'), quoted(c, '"'), F.lit('"'))
    head = ["@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", f"@prefix d2g: <{base}> ."]
    fixed = nodes.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, ord long, line string")
    triples = F.array_join(F.transform(entries(), lambda e: F.concat(F.lit(" ; d2g:"), safe_id(e["key"]), F.lit(" "), lit_(F.coalesce(e["value"].cast("string"), F.lit(""))))), "")
    n = nodes.select(F.lit(1).alias("part"), "ord", F.concat(F.lit("d2g:"), safe_id(F.col("id")), F.lit(" rdf:type d2g:"), safe_id(F.col("type")), F.lit(" ; rdfs:label "), lit_(F.col("label")), triples, F.lit(" .")).alias("line"))
    note = F.when(_text("evidence") != "", F.concat(F.lit(" # "), F.regexp_replace(F.substring("evidence", 1, EVIDENCE), r"[\r\n]+", " "))).otherwise("")
    e = edges.select(F.lit(2).alias("part"), "ord", F.concat(F.lit("d2g:"), safe_id(F.col("source")), F.lit(" d2g:"), safe_id(F.col("type")), F.lit(" d2g:"), safe_id(F.col("target")), F.lit(" ."), note).alias("line"))
    return fixed.unionByName(n).unionByName(e)


def stamp(at: datetime) -> Column:
    """A time as scripts and pages show it."""
    return F.date_format(F.lit(at), "yyyy-MM-dd HH:mm")


def cypher_lines(nodes: DataFrame, edges: DataFrame, create: bool = False, at: datetime | None = None) -> DataFrame:
    """MERGE statements, or CREATE with short evidence; ``at``: a comment with this time comes first."""
    s = lambda c: F.concat(F.lit("'"), quoted(c, "'"), F.lit("'"))
    name = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    pair = lambda k, v: F.concat(k, F.lit(": "), s(v))
    verb = F.lit("CREATE" if create else "MERGE")
    props = F.transform(entries(), lambda e: pair(name(e["key"]), F.coalesce(e["value"].cast("string"), F.lit(""))))
    shown = lambda *given: F.array_join(F.concat(F.filter(F.array(*given), lambda x: x.isNotNull()), props), ", ")
    some = lambda key, value: F.when(value != "", pair(F.lit(key), value))
    n = nodes.select(F.lit(1).alias("part"), "ord", F.concat(verb, F.lit(" (:"), name(F.col("type")), F.lit(" {"), shown(pair(F.lit("id"), F.col("id")), pair(F.lit("name"), F.col("label")), some("description", _text("description"))), F.lit("});")).alias("line"))
    short = F.substring(_text("evidence"), 1, 80 if create else EVIDENCE)
    about = shown(pair(F.lit("evidence"), short) if create else some("evidence", short), some("label", _text("label")))
    braced = F.when(about != "", F.concat(F.lit(" {"), about, F.lit("}"))).otherwise("")
    e = edges.select(F.lit(2).alias("part"), "ord", F.concat(F.lit("MATCH (a {id: "), s(F.col("source")), F.lit("}), (b {id: "), s(F.col("target")), F.lit("}) "), verb, F.lit(" (a)-[:"), name(F.col("type")), braced, F.lit("]->(b);")).alias("line"))
    head = nodes.sparkSession.range(1 if at else 0).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("// graph of "), stamp(at or datetime(1970, 1, 1))).alias("line"))
    return (head.unionByName(n) if at else n).unionByName(e)


def graph_json(nodes: DataFrame, edges: DataFrame) -> dict:
    """One object, for graphs that fit the driver."""
    rows = lambda df, *cols: [json.loads(x) for x in df.orderBy("ord").select(*cols).toJSON().toLocalIterator()]
    return {"nodes": rows(nodes, "id", "label", "type", "properties", "description"), "edges": rows(edges, "source", "target", "type", "label", "properties", "evidence")}


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ord, line) of one JSON object with all nodes and edges, an object a line."""

    def rows(table: DataFrame, part: int, *cols: str) -> DataFrame:
        first = table.agg(F.min("ord")).first()[0]  # has no comma before it
        body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
        return table.select(F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.when(F.col("ord") == first, "").otherwise(","), body).alias("line"))

    n = rows(nodes, 1, "id", "label", "type", "properties", "description")
    e = rows(edges, 3, "source", "target", "type", "label", "properties", "evidence")
    fixed = nodes.sparkSession.createDataFrame([(0, 0, '{"nodes": ['), (2, 0, '], "edges": ['), (4, 0, "]}")], "part int, ord long, line string")
    return fixed.unionByName(n).unionByName(e)


def write_lines(lines: DataFrame, path: str, one_file: bool = True, end: str = "\n") -> None:
    """Lines in order as one text file, or as parts in a folder in the order of their names.

    Either is written by the tasks.  For one file the parts are then copied behind each other as bytes, under another name until it is whole,
    so that a failure leaves no file, or the one that was there.
    """
    # breaks inside of a line stay as they are: rows end with ``end`` only
    writer = lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.mode("overwrite").option("lineSep", end)
    if not one_file:
        writer.text(path)
        return
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, parts, whole = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.parts-{uuid.uuid4().hex}", f"{path}.new-{uuid.uuid4().hex}"))
    fs = to.getFileSystem(conf)
    fs.setWriteChecksum(False)  # no files of checksums beside it
    try:
        writer.text(parts.toString())
        out = fs.create(whole, True)
        try:
            for part in sorted(x.getPath().getName() for x in fs.listStatus(parts)):
                if part.startswith("part-"):
                    read = fs.open(jvm.org.apache.hadoop.fs.Path(parts, part))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
                    finally:
                        read.close()
        finally:
            out.close()
        if fs.isDirectory(to):
            raise FileExistsError(f"{path} is a folder")
        fs.delete(to, False)
        fs.rename(whole, to)
    finally:
        fs.setWriteChecksum(True)
        fs.delete(parts, True)
        fs.delete(whole, False)


def write_tables(nodes: DataFrame, edges: DataFrame, base: str, form: str) -> str:
    """Nodes and edges as two tables of any size, Parquet or JSON lines, written by the tasks."""
    out = []
    for name, df in (("nodes", nodes.select("ord", "id", "label", "type", "properties", "description")), ("edges", edges.select("ord", "source", "target", "type", "label", "properties", "evidence"))):
        if form == "parquet":
            df.write.mode("overwrite").parquet(f"{base}_{name}.parquet")
        else:
            df.write.mode("overwrite").json(f"{base}_{name}.jsonl")
        out.append(f"{base}_{name}.{form}")
    return ", ".join(out)


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{margin:0;font:14px sans-serif}}#top{{padding:8px;background:#223;color:#fff}}#top button{{margin-left:6px}}canvas{{display:block;width:100vw;height:86vh;touch-action:none}}.t{{padding:0 6px;margin:2px;cursor:pointer;display:inline-block}}
#menu{{position:fixed;display:none;background:#fff;border:1px solid #888}}#menu div{{padding:4px 10px;cursor:pointer}}
</style></head><body><div id="top"><b>{title}</b> <span id="badge">{badge}</span> <small>{time}</small> <input id="q" placeholder="search"><button id="all">show all</button><button id="fit">fit</button><button id="png">PNG</button><button id="cy">.cypher</button><button id="copy">copy Cypher</button><div>{legend}</div></div><canvas id="c"></canvas><div id="menu"><div data-k="0">hide</div><div data-k="1">neighbours</div><div data-k="2">two steps</div><div data-k="pin">pin or release</div></div><pre id="info"></pre>
<script id="data" type="application/json">{data}</script><script>
const el=i=>document.getElementById(i),g=JSON.parse(el('data').textContent),c=el('c'),x=c.getContext('2d'),by=new Map();
g.nodes.forEach((n,i)=>{{const a=2*Math.PI*i/g.nodes.length;n.x=300*Math.cos(a);n.y=300*Math.sin(a);n.vx=n.vy=0;by.set(n.id,n)}});
const links=g.edges.map(e=>({{e,a:by.get(e.source),b:by.get(e.target)}})).filter(l=>l.a&&l.b),pairs=new Map();
links.forEach(l=>{{const k=[l.a.id,l.b.id].sort().join(' ');l.i=pairs.get(k)||0;pairs.set(k,l.i+1)}});
let zoom=1,ox=0,oy=0,hold=null,pan=null,text='',only=new Set(),gone=new Set(),near=null,target=null,pinch=0;
const shown=n=>!gone.has(n.id)&&(!near||near.has(n.id))&&(!only.size||only.has(n.type))&&(!text||n.label.toLowerCase().includes(text));
function step(){{const ns=g.nodes;for(let i=0;i<ns.length;i++)for(let j=i+1;j<ns.length;j++){{const a=ns[i],b=ns[j],dx=a.x-b.x,dy=a.y-b.y,d=dx*dx+dy*dy+20,f=900/d;a.vx+=dx*f/20;a.vy+=dy*f/20;b.vx-=dx*f/20;b.vy-=dy*f/20}}
links.forEach(({{a,b}})=>{{const dx=b.x-a.x,dy=b.y-a.y,d=Math.hypot(dx,dy)||1,f=(d-90)*.01;a.vx+=dx/d*f;a.vy+=dy/d*f;b.vx-=dx/d*f;b.vy-=dy/d*f}});
ns.forEach(n=>{{if(n===hold||n.pin)return;n.vx=(n.vx-n.x*.001)*.85;n.vy=(n.vy-n.y*.001)*.85;n.x+=n.vx;n.y+=n.vy}})}}
function draw(){{c.width=c.clientWidth;c.height=c.clientHeight;x.setTransform(zoom,0,0,zoom,c.width/2+ox,c.height/2+oy);
links.forEach(({{e,a,b,i}})=>{{if(!shown(a)||!shown(b))return;const k=i*18,mx=(a.x+b.x)/2+k,my=(a.y+b.y)/2-k;x.strokeStyle='#999';x.beginPath();x.moveTo(a.x,a.y);x.quadraticCurveTo(mx,my,b.x,b.y);x.stroke();x.fillStyle='#666';x.font='9px sans-serif';x.fillText(e.label||e.type,mx,my)}});
g.nodes.forEach(n=>{{if(!shown(n))return;x.fillStyle=n.color;x.beginPath();x.arc(n.x,n.y,9,0,7);x.fill();x.fillStyle='#111';x.font='11px sans-serif';x.fillText(n.label,n.x+11,n.y+4)}})}}
function fit(){{const v=g.nodes.filter(shown);if(!v.length)return;const xs=v.map(n=>n.x),ys=v.map(n=>n.y),a=Math.min(...xs),b=Math.max(...xs),d=Math.min(...ys),e=Math.max(...ys);zoom=Math.min(4,.9*Math.min(c.clientWidth/(b-a+60),c.clientHeight/(e-d+60)));ox=-zoom*(a+b)/2;oy=-zoom*(d+e)/2}}
function hop(n,k){{let seen=new Set([n.id]);for(let i=0;i<k;i++){{const more=[];links.forEach(({{a,b}})=>{{if(seen.has(a.id))more.push(b.id);if(seen.has(b.id))more.push(a.id)}});more.forEach(id=>seen.add(id))}}return seen}}
const at=(px,py)=>[(px-c.width/2-ox)/zoom,(py-c.height/2-oy)/zoom],hit=(px,py)=>{{const [p,q]=at(px,py);return g.nodes.find(n=>shown(n)&&Math.hypot(n.x-p,n.y-q)<12)}};
const down=(px,py)=>{{el('menu').style.display='none';hold=hit(px,py);if(hold)el('info').textContent=JSON.stringify({{id:hold.id,label:hold.label,type:hold.type,desc:hold.desc,props:hold.props}},null,1);else pan=[px-ox,py-oy]}};
const move=(px,py)=>{{if(hold)[hold.x,hold.y]=at(px,py);else if(pan){{ox=px-pan[0];oy=py-pan[1]}}}},up=()=>{{if(hold)hold.pin=true;hold=pan=null;pinch=0}};
c.onmousedown=e=>e.button||down(e.offsetX,e.offsetY);c.onmousemove=e=>{{move(e.offsetX,e.offsetY);const n=hit(e.offsetX,e.offsetY);c.title=n?n.label+' ('+n.type+')':''}};c.onmouseup=up;
const spot=t=>[t.clientX-c.offsetLeft,t.clientY-c.offsetTop],apart=t=>Math.hypot(t[0].clientX-t[1].clientX,t[0].clientY-t[1].clientY);
c.ontouchstart=e=>{{e.preventDefault();if(e.touches.length>1){{up();pinch=apart(e.touches)}}else down(...spot(e.touches[0]))}};
c.ontouchmove=e=>{{e.preventDefault();if(pinch&&e.touches.length>1){{const d=apart(e.touches);zoom*=d/pinch;pinch=d}}else move(...spot(e.touches[0]))}};c.ontouchend=up;
c.onwheel=e=>{{zoom*=e.deltaY<0?1.1:.9;e.preventDefault()}};
c.oncontextmenu=e=>{{e.preventDefault();target=hit(e.offsetX,e.offsetY);if(!target)return;const m=el('menu');m.style.display='block';m.style.left=e.clientX+'px';m.style.top=e.clientY+'px'}};
el('menu').onclick=e=>{{const k=e.target.dataset.k;if(k==='0')gone.add(target.id);else if(k==='pin')target.pin=!target.pin;else if(k)near=hop(target,+k);el('menu').style.display='none'}};
el('q').oninput=e=>text=e.target.value.trim().toLowerCase();el('all').onclick=()=>{{gone.clear();only.clear();near=null}};el('fit').onclick=fit;
const save=(href,name)=>{{const a=document.createElement('a');a.href=href;a.download=name;a.click()}};
el('png').onclick=()=>save(c.toDataURL(),'graph.png');el('cy').onclick=()=>save(URL.createObjectURL(new Blob([g.cypher])),'graph.cypher');el('copy').onclick=()=>navigator.clipboard.writeText(g.cypher);
document.querySelectorAll('.t').forEach(t=>t.onclick=()=>{{const k=t.dataset.type;only.has(k)?only.delete(k):only.add(k)}});
let steps=0;(function loop(){{step();if(++steps===120)fit();draw();requestAnimationFrame(loop)}})();
</script></body></html>
"""


def viewer(nodes: DataFrame, edges: DataFrame, title: str, most_nodes: int = 5_000, at: datetime | None = None) -> str:
    """A page with the first ``most_nodes`` nodes and a CREATE script of them; nothing in the data can end its script element."""
    from html import escape

    n = viewer_nodes(nodes).orderBy("ord").limit(most_nodes)
    shown = [json.loads(r) for r in n.toJSON().toLocalIterator()]
    ids = nodes.sparkSession.createDataFrame([(r["id"],) for r in shown], "id string")
    links = [json.loads(r) for r in viewer_edges(ids, edges).toJSON().toLocalIterator()]
    part = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    script = cypher_lines(nodes.join(ids, "id", "left_semi"), part, create=True)
    cypher = "\n".join(r["line"] for r in script.orderBy("part", "ord").select("line").toLocalIterator())
    data = json.dumps({"nodes": shown, "edges": links, "cypher": cypher}, ensure_ascii=False).replace("<", "\\u003c")
    total = stats(nodes, edges).first()
    legend_ = "".join(f'<span class="t" data-type="{escape(r["type"])}" style="background:{r["color"]}">{escape(r["type"])}</span>' for r in legend(nodes).collect())
    kinds = len(total["node_types"])
    return PAGE.format(title=escape(title), badge=f"{total['nodes']} nodes, {total['edges']} edges, {kinds} types", time=(at or datetime.now()).strftime("%Y-%m-%d %H:%M"), legend=legend_, data=data)


def export_all(nodes: DataFrame, edges: DataFrame, base: str, formats: list[str], one_file: bool = True, at: datetime | None = None) -> dict[str, str]:
    """Writes each format next to ``base`` (suffixes are added); returns what was written or went wrong.

    All but html are written by the tasks: json always as one file, parquet and jsonl as folders, the others as one file, or as folders of parts without ``one_file``.
    """

    def two_files(kind: str) -> str:
        if one_file:
            write_lines(csv_lines(nodes, node_columns()), f"{base}_nodes.csv", end="\r\n")
            write_lines(csv_lines(edges, edge_columns()), f"{base}_relationships.csv", end="\r\n")
            return f"{base}_nodes.csv, {base}_relationships.csv"
        for name, df in (("nodes", csv_nodes(nodes.orderBy("ord"))), ("relationships", csv_edges(edges.orderBy("ord")))):
            df.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n").csv(f"{base}_{name}.csv")
        return f"{base}_nodes.csv, {base}_relationships.csv"

    def lines(ext: str, make: Callable) -> str:
        write_lines(make(nodes, edges), base + ext, one_file)
        return base + ext

    def as_json(_: str) -> str:
        write_lines(json_lines(nodes, edges), base + ".json")
        return base + ".json"

    def as_html(_: str) -> str:
        with open(base + ".html", "w", encoding="utf-8") as f:
            f.write(viewer(nodes, edges, base.rsplit("/", 1)[-1], at=at))
        return base + ".html"

    def cypher(n: DataFrame, e: DataFrame) -> DataFrame:
        return cypher_lines(n, e, at=at or datetime.now())

    tables = lambda form: write_tables(nodes, edges, base, form)
    makers = {"json": as_json, "html": as_html, "neo4j": two_files, "csv": two_files, "parquet": tables, "jsonl": tables, "graphml": lambda _: lines(".graphml", graphml_lines), "turtle": lambda _: lines(".ttl", turtle_lines), "rdf": lambda _: lines(".ttl", turtle_lines), "cypher": lambda _: lines(".cypher", cypher)}
    out = {}
    for f in formats:
        try:
            out[f] = makers[f.lower()](f.lower()) if f.lower() in makers else f"unknown format: {f}"
        except Exception as e:  # one sink's failure leaves the others alone
            out[f] = f"failed: {e}"
    return out
