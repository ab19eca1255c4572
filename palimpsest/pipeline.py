"""The whole run: files to pages to transcriptions to documents, as one chain of tables.

Text found in a file is taken as it is (state 'extracted'); other pages go to the recognisers,
their outputs are reconciled, and only pages whose strategy asks for it go to a merging
model. Every stage is a DataFrame; tables are written by Spark's commit protocol under the
output folder:

    pages/     one row a page: state, text, confidence, cost, metadata
    outputs/   one row a page and engine
    documents/ one row a file with frontmatter
    formats/   one row a page and output format

``pages`` is a keyed, versioned table (``operators/store.py``): a second run takes up the pages that are not done, and
all pages of files whose content has changed, whose old pages go; a run that breaks off leaves the table as it was.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from . import dims, progress, services
from .config import Config
from .formats import formatter
from .formats.pages import BLOCKS
from .functions import display
from .functions import text as T
from .operators import assemble, costing, layout, metadata, reconcile, state, store
from .sources import files, images, reader

KEY = ["path", "page_index"]
logger = logging.getLogger(__name__)


@dataclass
class Pipeline:
    """A configured run. ``engines``: recognisers; ``merger``: the merging model (none: picks decide)."""

    spark: SparkSession
    config: Config
    engines: list = field(default_factory=list)
    merger: services.Merger | None = None
    parsers: dict | None = None

    def discover(self) -> DataFrame:
        return files.detect(files.scan(self.spark, self.config.input_dir, list(self.config.input_extensions)))

    def pending(self, found: DataFrame) -> DataFrame:
        """Files that the state table does not show as done with the same content."""
        done = store.pages_table(self.spark, self.config.output_dir).read()
        if done is None:
            return found
        finished = done.groupBy("path", "sha256").agg(F.bool_and(F.col("status").isin(state.DONE)).alias("ok")).filter("ok").select("path", "sha256")
        return found.withColumn("sha256", F.coalesce(F.sha2("content", 256), F.lit(""))).join(finished, ["path", "sha256"], "left_anti").drop("sha256")

    def pages(self, found: DataFrame) -> DataFrame:
        d = reader.pages(found, self.parsers, self.config.test_mode)
        status = F.when(F.col("error").isNotNull(), "failed").when(~T.blank(F.col("text")), "extracted").otherwise("pending")
        return d.withColumn("status", status)

    def recognised(self, pages: DataFrame, found: DataFrame) -> DataFrame:
        """One row for each pending page and engine."""
        todo = images.of_pages(found, pages.filter("status = 'pending'").select(*KEY))
        return services.recognize(todo, self.engines, KEY, list(self.config.languages))

    def reconciled(self, outputs: DataFrame) -> DataFrame:
        """(path, page_index, text, status, confidence, estimated_cost, engines_agreement, model, outputs)."""
        c = self.config
        d = reconcile.reconcile(outputs, KEY, c.vlm_enabled and self.merger is not None, c.vlm_agreement_threshold)
        if c.budget_cap_usd is not None:
            # in order of pages, over the whole run
            asked = d.filter("merge_strategy = 'vlm'").select(*KEY, F.lit(c.vlm_cost_per_call).alias("_cost"))
            wants = costing.admit_run(asked, c.budget_cap_usd, KEY, "_cost", "_cost").select(*KEY, F.col("admitted").alias("_ok"))
            d = d.join(wants, KEY, "left").withColumn("merge_strategy", F.when((F.col("merge_strategy") == "vlm") & ~F.coalesce("_ok", F.lit(False)), "pick_best").otherwise(F.col("merge_strategy"))).drop("_ok")
        all_text = F.array_join(F.transform("outputs", lambda o: F.coalesce(o["text"], F.lit(""))), " ")
        prof = settings.profile(c.profile)
        d = reconcile.route_model(d.withColumns({"_text": all_text, "_profile": F.lit(prof.name)}), "_profile", "_text", dims.dim_routing(self.spark, {prof.name: prof}), c.vlm_model).drop("_text", "_profile")
        marker = F.get(F.filter("outputs", lambda o: (o["engine"] == "marker") & o["error"].isNull()), 0)["text"]
        d = d.withColumns({"message": reconcile.user_message(F.col("outputs")), "marker_text": marker})
        plain = d.filter("merge_strategy <> 'vlm'").withColumns({"merged_text": F.col("picked_text"), "merge_cost": F.lit(0.0), "model_used": F.lit(None).cast("string")})
        if self.merger is None:
            out = plain
        else:
            prompt = reconcile.system_prompt(prof, c.column_layout, list(c.languages), c.vlm_system_prompt)
            asked = services.merge(d.filter("merge_strategy = 'vlm'"), self.merger, KEY, prompt, c.vlm_fallback_model, services.poor_answer)
            out = plain.unionByName(asked.withColumn("merged_text", F.coalesce("merged_text", "picked_text")), allowMissingColumns=True)
        failed = F.col("merge_strategy") == "failed"
        return out.select(
            *KEY, F.col("merged_text").alias("text"), F.when(failed, "failed").otherwise("complete").alias("status"), F.when(failed, "All OCR engines failed").alias("error"), "confidence",
            (F.col("engine_cost") + F.col("merge_cost")).alias("estimated_cost"), "engines_agreement", F.col("model_used").alias("model"), "merge_strategy", "outputs",
        )

    def finished_pages(self, pages: DataFrame, merged: DataFrame | None) -> DataFrame:
        empty = {"confidence": "double", "estimated_cost": "double", "engines_agreement": "double", "model": "string", "merge_strategy": "string", "blocks": BLOCKS}
        d = pages
        if merged is None:
            d = d.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()}).withColumn("outputs", F.array().cast("array<struct<engine:string,text:string,error:string>>"))
            d = d.withColumns({"error": F.when(F.col("status") == "pending", "no engine").otherwise(F.col("error")), "status": F.when(F.col("status") == "pending", "failed").otherwise(F.col("status"))})
        else:
            m = merged.select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("text", "status", "error")), *empty, F.transform("outputs", lambda o: F.struct(o["engine"].alias("engine"), o["text"].alias("text"), o["error"].alias("error"))).alias("outputs"))
            d = d.join(m, KEY, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("text", "status", "error")}).drop("_text", "_status", "_error")
        text = T.postprocess(F.coalesce("text", F.lit("")), self.config.postprocess_steps) if self.config.postprocess_enabled else F.coalesce("text", F.lit(""))
        return d.withColumns({"text": F.when(F.col("status") == "complete", text).otherwise(F.coalesce("text", F.lit(""))), "estimated_cost": F.coalesce("estimated_cost", F.lit(0.0)), "short_sha": display.short_sha(F.col("sha256"))})

    def with_comments(self, pages: DataFrame) -> DataFrame:
        """Page texts that name their document, where metadata is known."""
        m = F.col("metadata")
        known = (m["extraction_method"] != "none") & (m["extraction_method"] != "")
        named = display.page_comment(F.col("text"), F.col("page_index"), m["title"], F.get(m["authors"], 0), m["language"], m["document_type"])
        return pages.withColumn("text", F.when(known & F.lit(self.config.include_metadata_per_page) & ~T.blank(F.col("text")), named).otherwise(F.col("text")))

    def documents(self, pages: DataFrame) -> DataFrame:
        """(path, short_sha, document, n_pages): pages in order under frontmatter, sidecar fields filled in."""
        body = assemble.documents(pages, ["path", "short_sha"])
        meta = pages.groupBy("path").agg(F.min_by("metadata", "page_index").alias("m")).select("path", "m.*")
        meta = metadata.fill_from_sidecar(meta, reader.sidecars(self.spark, self.config.input_dir), "path")
        d = body.join(meta, "path", "left")
        return d.select("path", "short_sha", "n_pages", assemble.frontmatter_document(d.drop("extra")).alias("document"), *(c for c in ("title", "language", "extraction_method")))

    def process_one(self, path: str) -> dict:
        """A run over one file: the counts of its pages."""
        self.run(files.detect(files.scan(self.spark, path)))
        done = store.pages_table(self.spark, self.config.output_dir).read()
        return state.run_stats(done.filter(F.col("path").endswith(path.removeprefix("file:")))).first().asDict()

    def run(self, found: DataFrame | None = None) -> dict:
        """Write all tables, for ``found`` (as ``discover`` gives it) or all files; the counts of all pages."""
        out = self.config.output_dir.rstrip("/")
        table = store.pages_table(self.spark, out)
        found = self.pending(self.discover() if found is None else found)
        # files are read and parsed once: what follows starts from a table
        self.pages(found).write.mode("overwrite").parquet(f"{out}/parsed")
        pages, before = self.spark.read.parquet(f"{out}/parsed"), table.read()
        if before is not None:
            pages = state.pages_to_do(pages, before, [*KEY, "sha256"])
        merged = None
        if self.engines:
            # calls are made once: their results are a table before anything reads them twice
            self.recognised(pages, found).write.mode("overwrite").parquet(f"{out}/outputs")
            outputs = self.spark.read.parquet(f"{out}/outputs")
            seen = layout.page_blocks(outputs, KEY)
            self.reconciled(outputs).join(seen, KEY, "left").write.mode("overwrite").parquet(f"{out}/merged")
            merged = self.spark.read.parquet(f"{out}/merged")
        finished, seen = progress.observed(self.with_comments(self.finished_pages(pages, merged)))
        table.merge(finished, "run", table.head().writers.get("run", 0) + 1)
        logger.info("pages of this run: %s", seen.get)
        done = table.read()
        self.documents(done).write.mode("overwrite").parquet(f"{out}/documents")
        for name in self.config.output_formats:
            formatter(name)(done).select("short_sha", "page_label", F.lit(name).alias("output_format"), "content").write.mode("overwrite").partitionBy("output_format").parquet(f"{out}/formats/{name}")
        return state.run_stats(done).first().asDict()

    def collection(self) -> DataFrame:
        """All documents in order, one row each."""
        return assemble.collection_parts(self.spark.read.parquet(f"{self.config.output_dir}/documents"), ["short_sha", "path"])


def write_text_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's content to a file of its own (whole or not at all); (path) of what was written.

    Files are named by content, so a repeated task rewrites the same bytes."""
    import os

    from pyarrow import fs

    reader.bound_batches(rows.sparkSession)

    def run(batches):
        for pdf in batches:
            for n, c in zip(pdf[name], pdf[content], strict=True):
                path = f"{folder.rstrip('/')}/{n}"
                system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                system.create_dir(os.path.dirname(where), recursive=True)
                own = f"{where}.{os.getpid()}.tmp"
                with system.open_output_stream(own) as f:
                    f.write((c or "").encode())
                system.move(own, where)
            import pandas as pd

            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{n}" for n in pdf[name]]})

    return rows.select(name, content).mapInPandas(run, "path string")
