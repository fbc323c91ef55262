"""The tools of the serving layer as one façade: names, arguments and dispatch, whatever carries the calls."""

from __future__ import annotations

import inspect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph_query, summary
from loomgraph.operators.graph_build import Graph
from loomgraph.plans import search
from loomgraph.sources import tables


@dataclass
class Service:
    """corpus: tasks and chunks. graph: None where there is none. categories(relation, category): decisions. Queries are embedded by
    the corpus' hooks."""

    corpus: search.Corpus
    graph: Graph | None = None
    categories: DataFrame | None = None

    #: The names of the tools.
    TOOLS = ("query_kg", "search_entities", "get_entity_info", "get_kg_stats", "trace_decision", "list_sessions", "get_session_tasks", "graph_rag_search", "summarize", "skeleton_summarize")

    def tools(self) -> dict[str, list[str]]:
        """The arguments of every tool."""
        return {n: [p for p in inspect.signature(getattr(self, n)).parameters] for n in self.TOOLS}

    def call(self, tool: str, **arguments) -> DataFrame:
        if tool not in self.TOOLS:
            raise KeyError(f"no tool {tool}")
        return getattr(self, tool)(**arguments)

    def health(self) -> dict[str, bool]:
        return {"tasks": not self.corpus.tasks.isEmpty(), "graph": self.graph is not None and not self.graph.nodes.isEmpty()}

    def _query(self, text: str) -> DataFrame:
        q = self.corpus.tasks.sparkSession.createDataFrame([(0, text)], "query int, text string")
        return q.withColumn("embedding", self.corpus.hooks.embed(F.col("text")))

    def query_kg(self, entity: str, depth: int = 2, max_nodes: int = 30) -> DataFrame:
        return graph_query.query_kg(self.graph, self.corpus.tasks, entity, max(1, min(3, depth)), max(1, min(200, max_nodes)))

    def search_entities(self, query: str, limit: int = 20) -> DataFrame:
        return graph_query.search_ranked(self.graph.nodes, query, limit)

    def get_entity_info(self, name: str) -> DataFrame:
        """The node's edges in both directions, each beside the node."""
        return graph_query.get_nodes(self.graph.nodes, [name]).crossJoin(graph_query.get_edges(self.graph.edges, name))

    def get_kg_stats(self) -> DataFrame:
        return graph_query.stats(self.graph.nodes, self.graph.edges)

    def trace_decision(self, entity: str, max_hops: int = 2) -> DataFrame:
        return graph_query.trace(self.graph.edges, self.categories, entity, max_hops).orderBy("hop", "category")

    def list_sessions(self, limit: int = 20) -> DataFrame:
        return summary.list_sessions(self.corpus.tasks, limit)

    def get_session_tasks(self, session) -> DataFrame:
        return summary.session_tasks(self.corpus.tasks, session)

    def graph_rag_search(self, query: str, top_k: int = 8) -> DataFrame:
        return search.graph_rag(self.corpus, self.graph, self._query(query), top_k)

    def summarize(self, query: str, top_k: int = 8, level: str = "summary", since: str | None = None, until: str | None = None) -> DataFrame:
        """The packed contents that a summary is written from: by Graph-RAG where there is a graph, else by search."""
        q = self._query(query)
        if self.graph is not None:
            ranked = search.graph_rag(self.corpus, self.graph, q, top_k)
        else:
            ranked = search.rerank(search.candidates(self.corpus, q, 2 * top_k), q, self.corpus.tasks, self.corpus.hooks, top_k)
        return search.summarize(ranked, self.corpus.tasks, self.corpus.chunks, level, since=since, until=until)

    def skeleton_summarize(self, topic: str, max_tasks: int = 5) -> DataFrame:
        """The sections of the entity that a topic names, with the first max_tasks tasks by time; without such an entity the packed
        contents that summarize() gives for the topic."""
        name = resolve_topic(self.graph.nodes, topic) if self.graph is not None else None
        if name is None:
            return self.summarize(topic)
        return search.skeleton(self.graph, self.categories, name, tasks=self.corpus.tasks, limit=max_tasks)


def resolve_topic(nodes: DataFrame, topic: str) -> str | None:
    """The name that a topic means: equal, else the best fuzzy hit, else that of its longest word with one."""
    topic = topic.strip()
    if not graph_query.get_nodes(nodes, [topic]).isEmpty():
        return topic
    for part in [topic, *sorted((w for w in topic.split() if len(w) > 1), key=lambda w: (-len(w), w))]:
        hit = graph_query.search_ranked(nodes, part, 1).first()
        if hit:
            return hit["name"]
    return None


def build_context(graph: Graph, tasks: DataFrame, text: str, max_entities: int = 3, max_tasks: int = 10) -> DataFrame:
    """(task, ...): the tasks around the first entities that a text names, the first by name: what is injected into a prompt."""
    one = tasks.sparkSession.createDataFrame([(0, text)], "query int, text string")
    named = search.dictionary_entities(one, graph.nodes).orderBy(F.desc(F.length("entity")), "entity").limit(max_entities).select(F.col("entity").alias("name"))
    around = graph_query.bfs(graph.edges, named, 2, 30)
    found = graph.tasks.join(tables.small(around), "name", "left_semi").select("task").distinct()
    return tasks.join(found, "task", "left_semi").orderBy("task").limit(max_tasks)
