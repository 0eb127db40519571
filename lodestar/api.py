"""The library's operations by name, over frames: search, browse, health, evolve, compile, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import answering, capture, compiling, consistency, graph, ingest, linking, lint, models, publish, records, retrieval, vectors


class Wiki:
    """Pages (id, type, title, content, source, updated, ...) and their links (src, pos, target)."""

    def __init__(self, pages: DataFrame, links: DataFrame, as_of: str):
        self.pages, self.links, self.as_of = pages, links, as_of
        self.edges = graph.edges(links, pages)

    def search(self, question: str, limit: int = 10) -> DataFrame:
        return retrieval.search(self.pages, question, None, max(1, min(limit, 100)))

    def read_page(self, page: str) -> DataFrame:
        return self.pages.where(F.col("id") == page.lower())

    def list_pages(self, kind: str = "", limit: int = 200, offset: int = 0) -> DataFrame:
        rows = self.pages if not kind else self.pages.where((F.col("type") == kind) | F.startswith("id", F.lit(kind + "/")))
        return rows.orderBy("id").offset(max(0, offset)).limit(max(1, min(limit, 1000)))

    def stats(self) -> DataFrame:
        return self.pages.groupBy("type").agg(F.count("*").alias("pages"))

    def ask(self, question: str, model=models.stub, **context) -> DataFrame:
        """An answer with what it cites; see answering.ask."""
        return answering.ask(self.pages, question, model, as_of=self.as_of, **context)

    def lint(self, sources: DataFrame | None = None) -> DataFrame:
        """The issues of all checks."""
        return lint.run_all(self.pages, self.links, self.edges, self.as_of, sources)

    def lint_report(self, sources: DataFrame | None = None) -> DataFrame:
        return lint.summary_lines(self.lint(sources))

    def check_page(self, page: str, cited: DataFrame, sources: DataFrame, kind: str = "fidelity") -> DataFrame:
        return consistency.checks(self.pages.where(F.col("id") == page), cited.where(F.col("id") == page), sources, kind)

    def consistency_report(self, cited: DataFrame) -> DataFrame:
        found = consistency.groups(cited, graph.weak_components(self.pages, self.edges), consistency.overlapping(self.pages))
        return consistency.report(found, self.pages)

    def ingest(self, sources: DataFrame, manifest: DataFrame, extractions: DataFrame) -> dict[str, DataFrame]:
        """What new sources change; see ingest.taken_in."""
        return ingest.taken_in(sources, manifest, extractions, self.pages, self.as_of)

    def capture(self, inputs: DataFrame, taken: DataFrame, model=capture.stub) -> tuple[DataFrame, DataFrame]:
        return capture.capture(inputs, taken, model)

    def index(self, path: str) -> None:
        """Write the search index; retrieval.ask_index() asks it."""
        retrieval.write_index(self.pages, path)

    def compile(self, path: str, sources: DataFrame, take_in, **how) -> compiling.Report:
        """Take in what is new or changed of sources into the tables at path; see compiling.Compiler.compile."""
        return compiling.Compiler(sources.sparkSession, path).compile(sources, take_in, **how)

    def rebuild(self, path: str, now: str) -> dict[str, str]:
        """Wipe what is derived from the tables at path and build its indexes anew."""
        return compiling.Compiler(self.pages.sparkSession, path).rebuild(now)

    def index_vectors(self, path: str) -> None:
        """Build the index of the pages' vectors at path; hybrid() asks it."""
        vectors.VectorIndex(self.pages.sparkSession, path).build(vectors.embedded(self.pages))

    def hybrid(self, path: str, question: str, limit: int = 10) -> DataFrame:
        """search() by terms and by the vectors of the index at path."""
        k = max(1, min(limit, 100))
        near = retrieval.asked_index(vectors.VectorIndex(self.pages.sparkSession, path), question, 2 * k)
        return retrieval.search(self.pages, question, None, k, near=near)

    def link_titles(self, titles: DataFrame) -> DataFrame:
        """Pages with links to the titles (nth, title, target) that they mention."""
        return linking.injected(self.pages, titles)

    def evolve(self) -> dict[str, DataFrame]:
        new = lint.dead_links(self.links, self.pages).groupBy("target").agg(F.count("*").alias("n"))
        return {"connections": records.connections(self.pages, self.edges), "new_pages": new, "stubs": lint.stubs(self.pages)}

    def drift(self, manifest: DataFrame, sources: DataFrame) -> DataFrame:
        return records.drift(manifest, sources)

    def affected_pages(self, page: str) -> DataFrame:
        back = self.links.where(F.col("target") == page).select(F.col("src").alias("page"))
        own = F.broadcast(self.pages.where(F.col("id") == page).select(F.col("source").alias("s")).limit(1))
        return back.union(self.pages.where(F.col("id") != page).join(own, F.col("source") == F.col("s"), "left_semi").select("id")).distinct()

    def reliability(self, feedback: DataFrame) -> DataFrame:
        return records.page_trust(feedback)

    def verdict_trends(self, verdicts: DataFrame) -> DataFrame:
        return records.weekly(verdicts)

    def graph_viz(self, most: int = 30) -> DataFrame:
        return graph.mermaid(self.edges, graph.degrees(self.pages, self.edges), most)

    def publish(self) -> dict[str, DataFrame]:
        return {"index": publish.index_lines(self.pages), "full": publish.within_budget(self.pages), "graph": publish.jsonld(self.pages, self.links), "siblings": publish.siblings(self.pages), "sitemap": publish.sitemap(self.pages)}
