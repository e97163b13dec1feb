"""Execution plans as a tree of operator names that stay the same across Spark versions."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame

# Operator names of plans.
_NAMES = [
    ("HashJoin", "HashMatch"), ("SortMergeJoin", "HashMatch"), ("NestedLoopJoin", "NestedLoops"), ("CartesianProduct", "NestedLoops"), ("WindowGroupLimit", "Top"), ("Window", "Rank"),
    ("Aggregate", "StreamAggregate"), ("TakeOrdered", "Top"), ("Limit", "Top"), ("Sort", "Sort"), ("Filter", "Filter"), ("Project", "ComputeScalar"), ("Union", "Concatenation"),
    ("LocalTableScan", "ConstantScan"), ("OneRow", "ConstantScan"), ("Range", "ConstantScan"), ("Scan", "Table"), ("Relation", "Table"), ("UnionLoop", "TableSpool"),
]


@dataclass
class PlanNode:
    operator: str
    spark: str
    detail: str
    children: list[PlanNode] = field(default_factory=list)
    metrics: dict[str, int] = field(default_factory=dict)

    def text(self, depth: int = 0) -> str:
        return "\n".join([f"{'  ' * depth}{self.operator} [{self.spark}]", *(c.text(depth + 1) for c in self.children)])

    def xml(self) -> ElementTree.Element:
        out = ElementTree.Element("node", operator=self.operator, spark=self.spark, detail=self.detail)
        out.extend(c.xml() for c in self.children)
        return out

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def from_xml(element: ElementTree.Element) -> PlanNode:
    return PlanNode(element.get("operator"), element.get("spark"), element.get("detail"), [from_xml(c) for c in element])


def show_plan(frame: DataFrame) -> PlanNode:
    """The physical plan of ``frame``, with the row counts of its nodes where it has run."""

    def node(plan) -> PlanNode:
        while plan.nodeName().startswith(("AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter")) or "QueryStage" in plan.nodeName():
            inner = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.plan() if "QueryStage" in plan.nodeName() else plan.children().head()
            plan = inner
        name = plan.nodeName()
        known = next((to for part, to in _NAMES if part in name), name)
        children = plan.children()
        metrics = plan.metrics()
        rows = {"rows": metrics.apply("numOutputRows").value()} if metrics.contains("numOutputRows") else {}
        return PlanNode(known, name, plan.verboseStringWithOperatorId()[:400], [node(children.apply(i)) for i in range(children.size())], rows)

    return node(frame._jdf.queryExecution().executedPlan())
