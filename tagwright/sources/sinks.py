"""Writers: bulk tables through Spark, exact single files through the driver for reports of bounded size."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas


def in_order(df: DataFrame, columns) -> DataFrame:
    """The given columns in order, NULL where the frame has none."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv_table(df: DataFrame, path: str, columns=schemas.ROW_COLUMNS) -> None:
    """Many files, in parallel."""
    in_order(df, columns).write.mode("overwrite").option("header", "true").option("nullValue", "").option("escape", '"').csv(path)


def write_csv_file(df: DataFrame, path: str, columns=schemas.ROW_COLUMNS) -> int:
    """One file with a byte order mark; rows stream through the driver, which holds one partition at a time."""
    n, target = 0, Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8-sig", newline="") as out:
        write = csv.writer(out)
        write.writerow(columns)
        for row in in_order(df, columns).toLocalIterator():
            write.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_mirror(rows: DataFrame, unmatched: DataFrame, out_root: str) -> None:
    """A tree like that of the photos: per source folder one CSV named after it (the root's is rows.csv), beside it unmatched.csv if there is any, and index/.

    Spark writes a part for each folder, in parallel; the driver only moves the files to their names, a few metadata operations per folder.
    """
    from tagwright.functions.names import folder_of
    from tagwright.operators.report import folder_index

    spark = rows.sparkSession
    staging = f"{out_root}/_parts"
    rows = rows.filter("duplicate_of IS NULL")
    for df, columns, name in ((rows, schemas.ROW_COLUMNS, "rows"), (unmatched, schemas.UNMATCHED_COLUMNS, "unmatched")):
        keyed = in_order(df, columns).withColumn("folder", folder_of(F.col("photo"))).repartition("folder")
        keyed.write.mode("overwrite").partitionBy("folder").option("header", "true").option("escape", '"').csv(f"{staging}/{name}")
    index = folder_index(rows, unmatched).withColumn("csv", mirror_path(F.col("folder")))
    index.write.mode("overwrite").option("header", "true").csv(f"{out_root}/index")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out_root).getFileSystem(spark._jsc.hadoopConfiguration())
    plain = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = {}
    for name in ("rows", "unmatched"):
        for status in fs.listStatus(path(f"{staging}/{name}")):
            if status.isDirectory():
                folder = plain(status.getPath().getName().split("=", 1)[1])
                found[folder, name] = next(f.getPath() for f in fs.listStatus(status.getPath()) if f.getPath().getName().startswith("part-"))
    for folder in sorted({f for f, _ in found}):
        home = out_root if folder == "." else f"{out_root}/{folder}"
        fs.mkdirs(path(home))
        target = path(f"{home}/{'rows' if folder == '.' else folder.rsplit('/', 1)[-1]}.csv")
        if (folder, "rows") in found:
            _move(fs, found[folder, "rows"], target)
        else:  # nothing but unmatched tags: a table without rows
            out = fs.create(target, True)
            out.write(csv_text([], schemas.ROW_COLUMNS).encode())
            out.close()
        if (folder, "unmatched") in found:
            _move(fs, found[folder, "unmatched"], path(f"{home}/unmatched.csv"))
    fs.delete(path(staging), True)


def _move(fs, source, target) -> None:
    fs.delete(target, False)
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


def mirror_path(folder: Column) -> Column:
    """Where ``write_mirror`` puts the table of a folder, below its root."""
    return F.when(folder == ".", "rows.csv").otherwise(F.concat(folder, F.lit("/"), F.regexp_extract(folder, "([^/]*)$", 1), F.lit(".csv")))


def sheets(rows: DataFrame, unmatched: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """The five sheets of the workbook, in order."""
    primary = rows.filter("duplicate_of IS NULL")
    return {"Wines": primary, "Needs review": primary.filter("needs_review = 'yes'"), "Duplicates": rows.filter("duplicate_of IS NOT NULL"), "Unmatched tags": unmatched, "Errors": errors}


def write_xlsx(rows: DataFrame, unmatched: DataFrame, errors: DataFrame, path: str, widest: int = 46, narrowest: int = 10, sampled: int = 400) -> None:
    """A workbook of the sheets; needs openpyxl, and rows that one file can hold."""
    from openpyxl import Workbook

    book = Workbook()
    book.remove(book.active)
    for name, df in sheets(rows, unmatched, errors).items():
        sheet, widths = book.create_sheet(name), [len(c) for c in df.columns]
        sheet.append(df.columns)
        for i, row in enumerate(df.toLocalIterator()):
            sheet.append([v if isinstance(v, (int, float, str)) or v is None else str(v) for v in row])
            if i < sampled:
                widths = [max(w, len(str(v or ""))) for w, v in zip(widths, row, strict=True)]
        for i, w in enumerate(widths, 1):
            sheet.column_dimensions[sheet.cell(1, i).column_letter].width = min(widest, max(narrowest, w + 2))
        sheet.freeze_panes, sheet.auto_filter.ref = "A2", sheet.dimensions
    book.save(path)


def json_schema(struct, names: dict | None = None) -> dict:
    """A closed JSON schema of a Spark struct: all keys required, nothing else allowed, nullable fields may be null."""
    kinds = {"string": "string", "double": "number", "integer": "integer", "long": "integer", "boolean": "boolean"}

    def of(kind) -> dict:
        if isinstance(kind, str):
            return {"type": kinds.get(kind, "string")}
        if kind["type"] == "array":
            return {"type": "array", "items": of(kind["elementType"])}
        fields = {f["name"]: (of(f["type"]) if not f["nullable"] else {"anyOf": [of(f["type"]), {"type": "null"}]}) for f in kind["fields"]}
        return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}

    return of(json.loads(struct.json()))


def csv_text(rows: list, columns: list[str]) -> str:
    out = io.StringIO()
    write = csv.writer(out)
    write.writerow(columns)
    write.writerows(rows)
    return out.getvalue()
