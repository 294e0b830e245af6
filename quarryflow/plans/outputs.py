"""Sinks: snapshots, tables by priority, notes, previews and pages.

Tables and notes are written by the executors; pages and previews hold a
capacity-limited or otherwise small result and are streamed through the driver.
"""

from __future__ import annotations

import html
import json
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import file_sink
from ..functions.text import escape_table, escape_yaml, first_filled, joined_list, paper_link, slugify, text_or_empty
from ..operators.ranking import PRIORITIES, report_order
from ..operators.state import READING

#: The columns of the sheets and of the index.
SHEET_FIELDS = (
    "priority", "relevance_score", "research_track", "related_project", "potential_use",
    "recommended_action", "keyword_tier", "semantic_score", "publication_date", "venue",
    "title_cn", "title", "authors", "research_question", "method_summary", "main_contributions",
    "why_relevant", "abstract_cn", "abstract", "doi_url", "reading_status", "paper_id",
)
INDEX_FIELDS = ("paper_id", "priority", "relevance_score", "related_project", "title", "doi_url")


def snapshot_path(root: str, profile: str, to_date: str, stage: str) -> str:
    return f"{root}/profile={profile}/to_date={to_date}/{stage}"


def snapshot(df: DataFrame, root: str, profile: str, to_date: str, stage: str) -> str:
    """A stage's records as JSON lines under profile and date; an existing snapshot is an error."""
    path = snapshot_path(root, profile, to_date, stage)
    df.write.mode("errorifexists").json(path)
    return path


def cells(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The fields as text cells; lists are joined, absent columns are empty."""
    kinds = dict(df.dtypes)
    return df.select(*[(joined_list(F.col(f)) if kinds.get(f, "").startswith("array") else text_or_empty(f) if f in kinds else F.lit("")).alias(f) for f in fields])


def write_sheets(df: DataFrame, path: str) -> None:
    """CSV sheets: a folder for each priority that has rows, and `all`."""
    sheet = cells(df, SHEET_FIELDS)
    sheet.withColumn("sheet", F.col("priority")).filter(F.col("sheet").isin(*PRIORITIES[:4])).write.partitionBy("sheet").option("header", True).csv(path + "/by_priority")
    sheet.write.option("header", True).csv(path + "/all")


#: Records of a workbook or page that a reader opens whole; larger results are written as sheets.
MOST_OPENED = 100_000


def _opened_whole(df: DataFrame) -> DataFrame:
    if df.limit(MOST_OPENED + 1).count() > MOST_OPENED:
        raise ValueError(f"more than {MOST_OPENED} records for one file: write sheets")
    return df


def workbook(df: DataFrame, stats: dict[str, int]) -> bytes:
    """A small workbook: a summary, a sheet for each of A to D with rows, and all rows; headers frozen and filtered."""
    df = _opened_whole(df)
    rows = [list(r) for r in cells(df.orderBy(*report_order()), SHEET_FIELDS).toLocalIterator()]
    at = SHEET_FIELDS.index("priority")
    sheets = [("Summary", [["metric", "count"], *[[k, str(v)] for k, v in stats.items()]])]
    for p in PRIORITIES[:4]:
        if found := [r for r in rows if r[at] == p]:
            sheets.append((p, [list(SHEET_FIELDS), *found]))
    sheets.append(("All", [list(SHEET_FIELDS), *rows]))
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in _workbook_parts(sheets):
            z.writestr(name, body)
    return out.getvalue()


def _workbook_parts(sheets: list[tuple[str, list[list[str]]]]) -> Iterator[tuple[str, str]]:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
    yield "[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>'
    yield "_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    yield "xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    yield "xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>'
    for i, (_, rows) in enumerate(sheets, 1):
        widths = [min(55, max(12, max(len(r[c]) for r in rows) + 2)) for c in range(len(rows[0]))]
        cols = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths, 1))
        data = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows)
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
        yield f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}">{view}<cols>{cols}</cols><sheetData>{data}</sheetData><autoFilter ref="A1:{_column(len(rows[0]))}{len(rows)}"/></worksheet>'


def _cell(v: str) -> str:
    """A cell; addresses are links that can be clicked."""
    if v.startswith("https://") and '"' not in v and len(v) < 250:
        return f'<c t="str"><f>HYPERLINK("{escape(v)}")</f><v>{escape(v)}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'


def _column(n: int) -> str:
    return _column((n - 1) // 26) + chr(65 + (n - 1) % 26) if n > 0 else ""


#: A note's front matter, the headings of its parts and what stands for an empty one.
NOTE_FRONT = (("paper_id", "paper_id"), ("title", "title"), ("title_cn", "title_cn"), ("priority", "priority"), ("relevance_score", "relevance_score"), ("related_project", "related_project"), ("reading_status", "reading_status"), ("doi", "doi_url"))
NOTE_FACTS = (("Priority", "priority"), ("Relevance Score", "relevance_score"), ("Research Track", "research_track"), ("Related Project", "related_project"), ("Recommended Action", "recommended_action"))
NOTE_PARTS = (
    ("为什么值得读", "why_relevant", "(需人工判断)"),
    ("Research Question", "research_question", "(暂无)"),
    ("Method", "method_summary", "(暂无)"),
    ("Main Contributions", "main_contributions", "- (暂无)"),
    ("Potential Use", "potential_use", "(暂无)"),
    ("Original Title", "title", ""),
    ("Abstract EN", "abstract", "(No abstract)"),
    ("Abstract CN", "abstract_cn", "(暂无)"),
)
NOTE_END = "## 我的阅读笔记\n\n- Rating (1-5):\n- Reading status: new / saved / reading / read / ignored / cited\n- Note:"


def note_text(df: DataFrame) -> Column:
    """A Markdown note with front matter, of the columns that df has."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        return F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n") if kinds[c].startswith("array") else text_or_empty(c)

    quote = lambda c: F.lit("" if c == "relevance_score" else '"')  # noqa: E731 - a number stands without quotes
    front = [F.concat(F.lit(f"{name}: "), quote(c), escape_yaml(value(c)), quote(c)) for name, c in NOTE_FRONT]
    facts = [F.concat(F.lit(f"- {name}: "), value(c), F.lit("/100" if c == "relevance_score" else "")) for name, c in NOTE_FACTS]
    parts = [F.concat(F.lit(f"## {name}\n\n"), F.when(value(c) == "", F.lit(empty)).otherwise(value(c)), F.lit("\n")) for name, c, empty in NOTE_PARTS]
    heading = F.concat(F.lit("# "), first_filled(value("title_cn"), value("title")), F.lit("\n"))
    return F.concat_ws("\n", F.lit("---"), *front, F.lit("---\n"), heading, F.lit("## 推荐信息\n"), *facts, F.lit(""), *parts, F.lit(NOTE_END))


def write_notes(df: DataFrame, path: str) -> None:
    """The notes of `note_files` as tables: a folder of text for each note, and the index."""
    files = note_files(df)
    files.filter("name <> '_index.csv'").withColumn("value", F.col("body")).select("priority", F.col("name").alias("note"), "value").write.partitionBy("priority", "note").text(path + "/notes")
    files.filter("name = '_index.csv'").select(F.regexp_replace("body", "\r\n$", "").alias("value")).coalesce(1).write.text(path + "/index")


def note_files(df: DataFrame) -> DataFrame:
    """priority, name, body of each note of a reading queue (Ignore left out) and of the index, whose priority is empty.

    Of records with one date and slug the last stays, like a file written twice.
    The queue is limited by its capacity, so its index fits one row; it begins
    with the mark that spreadsheets take for UTF-8.
    """
    slug = F.concat_ws("_", first_filled("publication_date", F.lit("nodate")), slugify("title"))
    chosen = df.filter("priority <> 'Ignore'")
    notes = chosen.withColumn("name", F.concat(slug, F.lit(".md"))).groupBy("priority", "name").agg(F.max_by(note_text(df), "ord").alias("body"))
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in INDEX_FIELDS]
    cell = lambda c, q: F.when(F.col(c).rlike('[",\r\n]'), q).otherwise(F.col(c))
    lines = cells(_opened_whole(chosen), INDEX_FIELDS).select(F.concat_ws(",", *[cell(c, q) for c, q in zip(INDEX_FIELDS, quoted, strict=True)]).alias("line"))
    head = F.lit("\ufeff" + ",".join(INDEX_FIELDS))
    index = lines.agg(F.concat(F.concat_ws("\r\n", head, F.sort_array(F.collect_list("line"))), F.lit("\r\n")).alias("body"))
    return notes.unionByName(index.select(F.lit("").alias("priority"), F.lit("_index.csv").alias("name"), "body"))


def write_note_files(df: DataFrame, path: str) -> None:
    """One file for each note, `<priority>/<date>_<slug>.md`, and `_index.csv`, all at once or none: see `sources.file_sink`."""
    file_sink.write_files(note_files(df).select(F.concat_ws("/", F.nullif("priority", F.lit("")), "name").alias("path"), "body"), path)


def preview(df: DataFrame, stats: dict[str, int], limit: int = 50) -> str:
    """A Markdown table of the first rows in report order."""
    columns = ("priority", "relevance_score", "title", "venue", "publication_date")
    rows = df.orderBy(*report_order()).limit(limit).select(*[escape_table(c).alias(c) for c in columns]).collect()
    lines = [", ".join(f"{k}: {v}" for k, v in stats.items()), "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows)]) + "\n"


#: A reader's choice of text, priority, source, venue, days before the newest record and order, kept in the page alone.
CONTROLS = (
    "<input id=find placeholder=search><select id=only><option value=''>all</option><option>A</option><option>B</option><option>C</option><option>D</option></select>"
    "<select id=source><option value=''>all sources</option></select><select id=venue><option value=''>all venues</option></select><input id=days type=number min=0 placeholder=days>"
    "<select id=by><option value=''>report order</option><option value=score>relevance</option><option value=date>date</option></select>"
    "<script>addEventListener('load',()=>{const all=[...document.querySelectorAll('article')],box=all[0]?.parentNode,$=i=>document.getElementById(i);"
    "for(const f of ['source','venue'])for(const v of [...new Set(all.map(a=>a.dataset[f]))].filter(v=>v).sort())$(f).add(new Option(v,v));"
    "const newest=Math.max(...all.map(a=>Date.parse(a.dataset.date)||0));"
    "const show=()=>{const t=$('find').value.toLowerCase(),p=$('only').value,b=$('by').value,d=$('days').value;"
    "for(const a of all)a.hidden=!(a.textContent.toLowerCase().includes(t)&&(!p||a.dataset.priority===p)&&['source','venue'].every(f=>!$(f).value||a.dataset[f]===$(f).value)"
    "&&(d===''||Date.parse(a.dataset.date)>=newest-d*864e5));"
    "const s=b==='score'?[...all].sort((x,y)=>y.dataset.score-x.dataset.score):b==='date'?[...all].sort((x,y)=>y.dataset.date.localeCompare(x.dataset.date)):all;"
    "for(const a of s)box.append(a)};for(const i of ['find','only','source','venue','days','by'])$(i).oninput=show})</script>"
)


def report(df: DataFrame, title: str, stats: dict[str, int]) -> Iterator[str]:
    """An HTML page of all candidates in report order, piece by piece as the rows stream in."""
    ordered = df.orderBy(*report_order()).select("priority", "relevance_score", "title", "abstract", "venue", "publication_date", paper_link(F.col("doi"), text_or_empty("semantic_scholar_url") if "semantic_scholar_url" in df.columns else F.lit(""), text_or_empty("crossref_url") if "crossref_url" in df.columns else F.lit("")).alias("link"), first_filled("source").alias("source"))
    yield f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{CONTROLS}<h1>{html.escape(title)}</h1><p>" + html.escape(", ".join(f"{k}: {v}" for k, v in stats.items())) + "</p>"
    for r in ordered.toLocalIterator():
        e = {k: html.escape("" if v is None else str(v)) for k, v in r.asDict().items()}
        yield f'<article data-priority="{e["priority"]}" data-score="{e["relevance_score"]}" data-source="{e["source"]}" data-venue="{e["venue"]}" data-date="{e["publication_date"]}"><h2><a href="{e["link"]}">{e["title"]}</a></h2><p>{e["priority"]} · {e["relevance_score"]} · {e["venue"]} · {e["publication_date"]}</p><p>{e["abstract"]}</p></article>'


def app(df: DataFrame, profile: str, stats: dict[str, int]) -> str:
    """A page that holds the records as JSON, for a reader who rates them and exports feedback."""
    df = _opened_whole(df)
    fields = ("id", "stable_id", "title", "abstract", "venue", "publication_date", "doi_url", "priority", "relevance_score", "matched_keywords", "research_track", "related_project")
    have = [f for f in fields if f in df.columns]
    records = [json.loads(r[0]) for r in df.orderBy(*report_order()).select(F.to_json(F.struct(*have))).toLocalIterator()]
    data = json.dumps({"profile": profile, "stats": stats, "papers": records}, ensure_ascii=False).replace("<", "\\u003c")
    script = (
        "const d=JSON.parse(document.getElementById('data').textContent),k=p=>d.profile+':'+(p.id??p.stable_id),box=document.getElementById('list'),$=i=>document.getElementById(i);"
        "const kept=p=>JSON.parse(localStorage[k(p)]||'{}'),keep=(p,f,v)=>{localStorage[k(p)]=JSON.stringify({...kept(p),[f]:v})};"
        f"const states={json.dumps(READING)};"
        "for(const p of d.papers){const e=document.createElement('section');e.innerHTML='<h2></h2><p></p><input type=number min=1 max=5><select><option></option></select><input placeholder=note>';"
        "const [h,a,r,s,n]=e.children;h.textContent=p.priority+' '+p.title;a.textContent=p.abstract||'';for(const x of states)s.add(new Option(x,x));"
        "const o=kept(p);r.value=o.rating||'';s.value=o.reading_status||'';n.value=o.note||'';"
        "r.onchange=x=>keep(p,'rating',+x.target.value||undefined);s.onchange=x=>keep(p,'reading_status',x.target.value||undefined);n.onchange=x=>keep(p,'note',x.target.value||undefined);"
        "p.shown=e;box.append(e)}"
        "const show=()=>{const t=$('find').value.toLowerCase(),o=$('only').value;for(const p of d.papers)p.shown.hidden=!((p.title+' '+(p.abstract||'')+' '+(p.venue||'')).toLowerCase().includes(t)&&(!o||p.priority===o))};"
        "$('find').oninput=$('only').oninput=show;"
        "$('export').onclick=()=>{const f=d.papers.filter(p=>Object.keys(kept(p)).length).map(p=>({paper_id:p.id,stable_id:p.stable_id,related_project:p.related_project,timestamp:new Date().toISOString(),...kept(p)}));"
        "const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([JSON.stringify({profile:d.profile,feedback:f})]));a.download='feedback.json';a.click()}"
    )
    controls = "<input id=find placeholder=search><select id=only><option value=''>all</option><option>A</option><option>B</option><option>C</option><option>D</option><option>Ignore</option></select>"
    return f'<!doctype html><meta charset=utf-8><title>{html.escape(profile)}</title>{controls}<button id=export>Export feedback</button><div id=list></div><script type="application/json" id=data>{data}</script><script>{script}</script>'
