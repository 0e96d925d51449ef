"""Source adapters: each turns a folder of files into rows of one record schema.

``read(spark, type, path, source_id)`` looks an adapter up by its short name or
by a dotted path ``package.module:function``.
"""

from __future__ import annotations

import csv
import importlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.functions.normalize import native_band, split_multi
from archivum.operators.search import places
from archivum.sources.files import front_matter, parse_files

SCHEMA = "source_record_id string, name string, category string, description string, version string, extensions array<string>, mime_types array<string>, puids array<string>, loc_ids array<string>, nara_ids array<string>, wikidata_ids array<string>, record_role string, native string"
PUID = re.compile(r"(?:x-)?fmt/\d+")
QID = re.compile(r"\bQ[1-9]\d*\b")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split())


def _list(value) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [v.strip() for v in re.split(r"[;,|\n]+", value) if v.strip()]
    return [str(v).strip() for v in value if v is not None and str(v).strip()]


def _row(**fields) -> dict:
    base = {k: [] for k in ("extensions", "mime_types", "puids", "loc_ids", "nara_ids", "wikidata_ids")}
    return base | {"record_role": "format_identity"} | fields


# --- PRONOM ---------------------------------------------------------------------------


def _pronom_json(name: str, data: bytes) -> Iterator[dict]:
    try:
        doc = json.loads(data.decode("utf-8-sig"))
    except ValueError:
        return
    for d in doc if isinstance(doc, list) else [doc]:
        ids = d.get("identifiers") or []
        by = lambda kind: [i.get("identifierText") or i.get("value") for i in ids if str(i.get("identifierType") or i.get("type") or "").lower() == kind]
        found = re.search(r"((?:x-)?fmt)[/_-]?(\d+)", name)
        puid = (by("puid") or [f"{found.group(1)}/{found.group(2)}" if found else None])[0]
        if not puid:
            continue
        extensions = _list(d.get("extensions") or [s.get("externalSignature") for s in d.get("externalSignatures") or [] if str(s.get("signatureType", "")).lower().endswith("extension")])
        yield _row(
            source_record_id=puid, name=d.get("formatName") or d.get("name"), version=d.get("version"), description=d.get("formatDescription") or d.get("description"), category=", ".join(_list(d.get("formatTypes"))) or None,
            extensions=extensions, mime_types=_list(by("mime")), puids=[puid], native=json.dumps(d, sort_keys=True),
        )


def _droid_xml(name: str, data: bytes) -> Iterator[dict]:
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return
    for node in root.iter():
        if _local(node.tag) != "FileFormat" or not node.get("PUID"):
            continue
        title = " ".join(x for x in (node.get("Name"), node.get("Version")) if x)
        yield _row(
            source_record_id=node.get("PUID"), name=title, version=node.get("Version"), puids=[node.get("PUID")], mime_types=_list(node.get("MIMEType")),
            extensions=[_text(c) for c in node.iter() if _local(c.tag) == "Extension" and _text(c)], native=json.dumps(dict(node.attrib), sort_keys=True),
        )


# --- Library of Congress format descriptions --------------------------------------------

FACTORS = ("disclosure", "adoption", "transparency", "selfDocumentation", "externalDependencies", "patents", "technicalProtection")
_FACTOR_KEYS = {re.sub(r"[^a-z]", "", f.lower()): f for f in FACTORS} | {"impactofpatents": "patents", "technicalprotectionmechanisms": "technicalProtection", "technicalprotectionconsiderations": "technicalProtection"}


def _outside(node, skip: tuple[str, ...]):
    """All nodes that are not below a subtree about related formats."""
    for child in node:
        if not _local(child.tag).lower().startswith(skip):
            yield child
            yield from _outside(child, skip)


def _factors(root, reviewed: bool) -> dict[str, str]:
    """Factor texts by element name, by label attribute, or by a child that names it; the first value wins."""
    out: dict[str, str] = {}
    for node in root.iter():
        label = next((v for k, v in node.attrib.items() if _local(k).lower() in ("name", "label", "title", "type")), None)
        child = next((_text(c) for c in node if _local(c.tag).lower() in ("name", "label", "factor", "title")), None)
        for candidate in ([label, child] if reviewed else [_local(node.tag), label, child]):
            key = _FACTOR_KEYS.get(re.sub(r"[^a-z]", "", (candidate or "").lower()))
            if key and key not in out:
                text = " ".join(_text(c) for c in node if _local(c.tag).lower() not in ("name", "label", "factor", "title")) or _text(node)
                if text:
                    out[key] = text
    return out


def _loc_xml(reviewed: bool):
    def parse(name: str, data: bytes) -> Iterator[dict]:
        try:
            root = ET.fromstring(data)
        except ET.ParseError:
            return
        own = list(_outside(root, ("related", "relationship")))
        first = lambda *tags: next((_text(n) for t in tags for n in own if _local(n.tag).lower() == t and _text(n)), None)
        record = root.get("id") or first("fddid", "id") or (m.group(0) if (m := re.search(r"fdd\d+", name)) else None)
        if not record:
            return
        prose = " ".join(_text(n) for n in own if _local(n.tag).lower() in ("note", "notes", "p", "comment"))
        ids = " ".join(_text(n) for n in own if _local(n.tag).lower() in (("puid", "identifier", "wikidata") if reviewed else ("puid", "identifier", "wikidata", "note", "notes")))
        factors = _factors(root, reviewed)
        yield _row(
            source_record_id=record, name=root.get("titleName") or first("titlename", "title", "fullname", "shortname", "name"), category=first("contentcategory", "category", "gdfrgenre"), description=first("description", "shortdescription"),
            extensions=[_text(n) for n in own if _local(n.tag).lower() in ("extension", "fileextension", "sigvalue") and re.fullmatch(r"\.?[A-Za-z0-9]{1,12}", _text(n))],
            mime_types=[_text(n) for n in own if _local(n.tag).lower() in ("mimetype", "mime")], loc_ids=[record], puids=sorted(set(PUID.findall(ids))), wikidata_ids=sorted(set(QID.findall(ids))),
            native=json.dumps({"factors": factors, "context_ids": sorted(set(PUID.findall(prose)) | set(QID.findall(prose))) if reviewed else []}, sort_keys=True),
        )

    return parse


def _csv_rows(data: bytes) -> list[dict[str, str]]:
    return list(csv.DictReader(io.StringIO(data.decode("utf-8-sig", "replace"))))


def _key(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", (header or "").lower())


def _crosswalk(name: str, data: bytes) -> Iterator[dict]:
    """Ids come from the columns that own them, never from notes."""
    for r in _csv_rows(data):
        by = {_key(k): (v or "").strip() for k, v in r.items() if k}
        fdd = by.get("fdd") or by.get("lcuniqueid") or by.get("filename", "").removesuffix(".xml")
        if not fdd:
            continue
        yield _row(
            source_record_id=fdd, name=by.get("formattitle") or by.get("lclongname") or by.get("lcshortname"), loc_ids=[fdd], puids=sorted(set(PUID.findall(by.get("puid") or by.get("pronompuid") or ""))),
            wikidata_ids=sorted(set(QID.findall(by.get("wikidataqid") or by.get("wikidatatitleid") or ""))), record_role="evidence_only", native=json.dumps(r, sort_keys=True),
        )


# --- National Archives framework: companion files --------------------------------------------


def _nara_csv(name: str, data: bytes) -> Iterator[dict]:
    kind = 0 if "plan" in name.lower() else 1 if "risk" in name.lower() or "matrix" in name.lower() else 2
    for n, r in enumerate(_csv_rows(data)):
        by = {_key(k): k for k in r if k}
        ident = next(((r[by[k]] or "").strip() for k in ("naraformatid", "formatid", "id") if k in by), "")
        title = next(((r[by[k]] or "").strip() for k in ("formatname", "fileformat", "name") if k in by), "")
        yield {"merge_key": ident or title.lower() or f"{name}:{n}", "kind": kind, "file": name, "row_no": n, "native": json.dumps(r, sort_keys=True)}


def read_nara(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """One row per format from its companion files: later kinds override the columns they have, blank cells included."""
    rows = parse_files(spark, path, (".csv",), _nara_csv, "merge_key string, kind int, file string, row_no int, native string")
    cells = rows.select("merge_key", "kind", "file", "row_no", F.explode(F.from_json("native", "map<string,string>")).alias("column", "value"))
    last = cells.groupBy("merge_key", "column").agg(F.max_by("value", F.struct("kind", "file", "row_no")).alias("value"))
    merged = last.groupBy("merge_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "value")))).alias("cells"))
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.element_at("cells", F.lit(n))), F.lit("")) for n in names])
    rating = pick("NARA Total", "Numeric Risk Rating", "Total Numeric Risk Rating").try_cast("double")
    rubric = F.map_filter("cells", lambda k, v: k.rlike(r"^\d+[.．]\d+:") & v.isNotNull() & (F.trim(v) != ""))
    empty = F.array().cast("array<string>")
    return merged.select(
        F.coalesce(pick("NARA Format ID", "Format ID"), F.col("merge_key")).alias("source_record_id"), pick("Format Name", "File Format").alias("name"), pick("Category/Plan(s)", "Category").alias("category"), pick("Description").alias("description"),
        F.lit(None).cast("string").alias("version"), split_multi(pick("File Extension(s)", "Extension(s)")).alias("extensions"), empty.alias("mime_types"), F.regexp_extract_all(F.coalesce(pick("PRONOM URL", "PUID"), F.lit("")), F.lit(r"((?:x-)?fmt/\d+)"), 1).alias("puids"),
        empty.alias("loc_ids"), F.array_compact(F.array(pick("NARA Format ID", "Format ID"))).alias("nara_ids"), empty.alias("wikidata_ids"), F.lit("format_identity").alias("record_role"),
        F.to_json(F.struct("cells", rubric.alias("rubric"), F.struct(rating.alias("rating"), native_band(rating).alias("band"), F.lit("higher_is_safer").alias("direction")).alias("hazard"))).alias("native"),
        F.lit(source_id).alias("source_id"), F.lit("nara_digital_preservation_framework").alias("source_type"),
    )


# --- endangered list: front matter --------------------------------------------------------------

#: Classes of the list as governed levels (fixed values).
ENDANGERED_LEVEL = {"lower risk": "minimal", "vulnerable": "moderate", "endangered": "high", "critically endangered": "critical", "practically extinct": "critical"}


def _endangered(name: str, data: bytes) -> Iterator[dict]:
    head, body = front_matter(data.decode("utf-8", "replace"))
    title = head.get("title") or head.get("name")
    if not title:
        return
    label = str(head.get("classification") or head.get("status") or "").strip()
    level = ENDANGERED_LEVEL.get(label.lower().replace("-", " "))
    scope = "content_type" if str(head.get("category", "")).lower() in ("content", "media") else "format_group"
    yield _row(source_record_id=str(head.get("id") or re.sub(r"\.md$", "", name.rsplit("/", 1)[-1])), name=str(title), category=str(head.get("category") or "") or None, description=" ".join(body.split()) or None,
               extensions=_list(head.get("extensions")), record_role="evidence_only", native=json.dumps({"native_label": label, "semantic_level": level, "scope_type": scope}, sort_keys=True))


# --- spreadsheets ---------------------------------------------------------------------------------


def xlsx_rows(data: bytes) -> Iterator[list[str]]:
    """Cells of the first sheet as text, in order; empty cells are empty strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_text(n) for n in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(n.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n).group(1)), default=None)
        if sheet is None:
            return
        for row in ET.fromstring(z.read(sheet)).iter():
            if _local(row.tag) != "row":
                continue
            cells: dict[int, str] = {}
            for c in row:
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = len(cells) if not letters else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters.group()))) - 1
                value = next((n for n in c if _local(n.tag) in ("v", "is")), None)
                text = "" if value is None else _text(value)
                cells[at] = shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text
            yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def header_row(rows: list[list[str]], wanted: set[str], within: int = 30) -> int | None:
    """The row among the first ``within`` that names most of the wanted columns; at least two have to be there."""
    best = max(((len({_key(c) for c in r} & wanted), -n) for n, r in enumerate(rows[:within])), default=(0, 0))
    return -best[1] if best[0] >= 2 else None


#: The headers (letters and digits, folded) that stand for each field; a site gives its own to ``institution_sheets``.
INSTITUTION_FIELDS = {"institution_format_id": ("localnumber", "localcode", "recordno", "formatid", "id"), "name": ("formattitle", "formatname", "kindofobject", "name", "title"), "extensions": ("suffixes", "extensions", "fileextension", "filesuffixes"),
                      "local_risk_level": ("levelofrisk", "localrisk", "risklevel", "riskrating"), "local_preservation_action": ("agreedaction", "preservationaction", "preservationstep", "treatment"), "local_preservation_plan": ("preservationplan", "plan"),
                      "local_preferred_tools": ("software", "preferredsoftware", "preferredtools", "tools")}


def _institution_xlsx(name: str, data: bytes, fields: dict[str, tuple[str, ...]] = INSTITUTION_FIELDS) -> Iterator[dict]:
    rows = list(xlsx_rows(data))
    start = header_row(rows, {k for keys in fields.values() for k in keys})
    if start is None:
        return
    head = [_key(c) for c in rows[start]]
    at = {f: next((head.index(k) for k in keys if k in head), None) for f, keys in fields.items()}
    for n, r in enumerate(rows[start + 1 :], start + 2):
        get = lambda f: (r[at[f]].strip() or None) if at[f] is not None and at[f] < len(r) else None
        title = get("name")
        # Rules and totals between the rows are no formats.
        if not title or not re.search(r"[^\W\d_]{2}", title):
            continue
        policy = {f: get(f) for f in fields if f.startswith(("local", "institution"))} | {"source_file": name.rsplit("/", 1)[-1], "source_row": n}
        yield _row(source_record_id=get("institution_format_id") or f"row-{n}", name=title, extensions=_list(get("extensions")), native=json.dumps({"institution_policy": policy}, sort_keys=True))


# --- JSON packages -----------------------------------------------------------------------------------


def _package(name: str, data: bytes) -> Iterator[dict]:
    """``records``: ids under ``identifiers`` come before the typed fields."""
    try:
        doc = json.loads(data.decode("utf-8-sig"))
    except ValueError:
        return
    for n, r in enumerate(doc.get("records", []) if isinstance(doc, dict) else doc):
        if not isinstance(r, dict):
            continue
        ids = r.get("identifiers") or {}
        pick = lambda kind, field: _list(ids.get(kind) or ids.get(field) or r.get(field))
        yield _row(source_record_id=str(r.get("source_record_id") or r.get("id") or f"record-{n + 1}"), name=r.get("name"), category=r.get("category"), description=r.get("description"), version=r.get("version") or r.get("format_version"), extensions=pick("extension", "extensions"),
                   mime_types=pick("mime", "mime_types"), puids=pick("puid", "puids"), loc_ids=pick("loc", "loc_ids"), nara_ids=pick("nara", "nara_ids"), wikidata_ids=pick("wikidata", "wikidata_ids"), record_role=r.get("record_role") or "format_identity", native=json.dumps(r, sort_keys=True))


def _institution_evidence(name: str, data: bytes) -> Iterator[dict]:
    try:
        doc = json.loads(data.decode("utf-8-sig"))
    except ValueError:
        return
    for n, r in enumerate(doc.get("formats") or doc.get("records") or []):
        f = r.get("format") or r
        yield _row(source_record_id=str(r.get("source_record_id") or f"evidence-{n + 1}"), name=f.get("name"), category=f.get("category"), extensions=_list(f.get("extensions")), mime_types=_list(f.get("mime_types")), puids=_list(f.get("puids")), loc_ids=_list(f.get("loc_ids")), native=json.dumps({"evidence": r.get("evidence") or r.get("claims") or []}, sort_keys=True))


def _bridge(name: str, data: bytes) -> Iterator[dict]:
    """Approved bridges between authorities as identity evidence; drafts are no bridges."""
    try:
        doc = json.loads(data.decode("utf-8-sig"))
    except ValueError:
        return
    for r in doc.get("rules", []):
        if str(r.get("review_status", "")).startswith("approved") and r.get("fdd_id") and r.get("puid"):
            yield _row(source_record_id=r.get("rule_id") or f"{r['fdd_id']}:{r['puid']}", name=r.get("title"), loc_ids=[r["fdd_id"]], puids=[r["puid"]], native=json.dumps(r, sort_keys=True))


def _registry_json(name: str, data: bytes) -> Iterator[dict]:
    """A registry export: a list, an object under ``formats``, or an object by id."""
    try:
        doc = json.loads(data.decode("utf-8-sig"))
    except ValueError:
        return
    found = doc.get("formats", doc) if isinstance(doc, dict) else doc
    for key, f in found.items() if isinstance(found, dict) else ((None, x) for x in found):
        if not isinstance(f, dict) or not (f.get("canonical_id") or key):
            continue
        ids = f.get("identifiers") or {}
        yield _row(source_record_id=f.get("canonical_id") or key, name=f.get("preferred_name") or f.get("name"), category=f.get("category"), description=f.get("description"), version=f.get("version"), extensions=_list(ids.get("extension")), mime_types=_list(ids.get("mime")), puids=_list(ids.get("puid")), loc_ids=_list(ids.get("loc")), nara_ids=_list(ids.get("nara")), wikidata_ids=_list(ids.get("wikidata")), native=json.dumps(f, sort_keys=True))


def _evidence_csv(name: str, data: bytes) -> Iterator[dict]:
    """One claim a row, nested by format."""
    by: dict[str, list[dict]] = {}
    for r in _csv_rows(data):
        row = {_key(k): (v or "").strip() for k, v in r.items() if k}
        if title := row.get("formatname") or row.get("name"):
            by.setdefault(row.get("sourcerecordid") or title, []).append(row)
    for ident, claims in by.items():
        first = claims[0]
        yield _row(source_record_id=ident, name=first.get("formatname") or first.get("name"), category=first.get("category") or None, extensions=_list(first.get("extensions")), mime_types=_list(first.get("mimetypes")), puids=_list(first.get("puids")), native=json.dumps({"evidence": [{"criterion_id": c.get("criterionid"), "value": c.get("value")} for c in claims]}, sort_keys=True))


def select_release(releases: DataFrame, pinned: str | None = None, explicit: str | None = None) -> DataFrame:
    """The release to read, from (release, released_on, path): an explicit one, else the pinned one, else the latest."""
    wanted = F.when(F.lit(explicit).isNotNull() & (F.col("release") == explicit), 3).when(F.lit(pinned).isNotNull() & (F.col("release") == pinned), 2).otherwise(1)
    best = releases.agg(F.max_by(F.struct("release", "released_on", "path"), F.struct(wanted.alias("w"), F.col("released_on"), F.col("release"))).alias("r"))
    return best.where("r is not null").select("r.*")


# --- linked-data graph ---------------------------------------------------------------------------------


def merge_statements(statements: DataFrame) -> DataFrame:
    """(qid, predicate to values): entity-attribute-value rows as one row per entity, values distinct and sorted, ordered by number."""
    values = statements.where("value is not null and trim(value) != ''").groupBy("qid", "predicate").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"))
    merged = values.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "values")))).alias("properties"))
    return merged.withColumn("place", F.regexp_extract("qid", r"(\d+)$", 1).try_cast("bigint"))


def graph_records(merged: DataFrame, source_id: str) -> DataFrame:
    """Evidence rows of merged entities; they never form identity."""
    many = lambda p: F.filter(F.split(F.coalesce(F.element_at("properties", F.lit(p)), F.lit("")), r"\|"), lambda x: x != "")
    return merged.select(
        F.col("qid").alias("source_record_id"), F.element_at("properties", F.lit("label")).alias("name"), many("extension").alias("extensions"), many("mime").alias("mime_types"), many("puid").alias("puids"), many("loc").alias("loc_ids"), F.array("qid").alias("wikidata_ids"),
        F.lit("evidence_only").alias("record_role"), F.lit(source_id).alias("source_id"), F.lit("wikidata").alias("source_type"),
    )


# --- registry of adapters -------------------------------------------------------------------------------

PARSERS = {
    "pronom_registry": ((".json",), _pronom_json), "pronom_droid_xml": ((".xml",), _droid_xml), "loc_fdd_xml": ((".xml",), _loc_xml(False)), "loc_fdd_xml_reviewed": ((".xml",), _loc_xml(True)), "loc_crosswalk_csv": ((".csv",), _crosswalk),
    "endangered_list": ((".md",), _endangered), "institution_xlsx": ((".xlsx",), _institution_xlsx), "standard_json": ((".json",), _package), "institution_evidence_json": ((".json",), _institution_evidence),
    "institution_evidence_csv": ((".csv",), _evidence_csv), "approved_bridge_json": ((".json",), _bridge), "registry_json": ((".json",), _registry_json),
}
#: Presets and older names.
ALIASES = {"policy_xlsx": "institution_xlsx", "nara": "nara_digital_preservation_framework"}
#: Adapters whose rows are stored under another type.
STORED_AS = {"loc_fdd_xml_reviewed": "loc_fdd_xml"}


def read(spark: SparkSession, kind: str, path: str, source_id: str) -> DataFrame:
    """Records of a source: the common schema with source_id, source_type and ``src_ord``, the total input order."""
    kind = ALIASES.get(kind, kind)
    if ":" in kind:
        module, name = kind.split(":", 1)
        df = getattr(importlib.import_module(module), name)(spark, path, source_id)
    elif kind in ("nara_digital_preservation_framework", "nara_preservation_csv"):
        df = read_nara(spark, path, source_id)
    elif kind in PARSERS:
        suffixes, parse = PARSERS[kind]
        df = parse_files(spark, path, suffixes, parse, SCHEMA).withColumns({"source_id": F.lit(source_id), "source_type": F.lit(STORED_AS.get(kind, kind))})
    else:
        raise KeyError(f"no adapter {kind}")
    return df


def institution_sheets(spark: SparkSession, path: str, source_id: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Records of an institution's spreadsheets whose headers stand for ``fields`` (header keys in order of preference)."""
    df = parse_files(spark, path, (".xlsx",), lambda name, data: _institution_xlsx(name, data, fields), SCHEMA)
    return df.withColumns({"source_id": F.lit(source_id), "source_type": F.lit("institution_xlsx")})


def ordered(records: DataFrame) -> DataFrame:
    """Add ``src_ord``: a stable number by source and record.  One number per record of a source, so sources never collide.

    Ranges of the order are numbered where they are, so a source with a third of all records is no task of its own.
    """
    placed = places(records, [F.col("source_id"), F.col("source_record_id"), F.col("name")])
    first = placed.groupBy("source_id").agg(F.min("place").alias("__first"))
    number = (F.col("place") - F.col("__first") + 1).cast("string")
    out = placed.join(first.withColumnRenamed("source_id", "__source"), F.col("source_id").eqNullSafe(F.col("__source")))
    return out.withColumn("src_ord", F.concat_ws(":", "source_id", F.lpad(number, 12, "0"))).select(*records.columns, "src_ord")
