"""What a query's operators did when it ran."""

from collections.abc import Iterator


def nodes(plan) -> Iterator:
    """The operators of a plan that was executed, those of its stages included."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        yield plan
        children = plan.children()
        for k in range(children.size()):
            yield from nodes(children.apply(k))


def rows_made(df, kind: str) -> int:
    """The most rows that an operator of a kind made while the frame was collected."""
    df.collect()
    made = [n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if kind in n.getClass().getSimpleName()]
    return max(made, default=0)
