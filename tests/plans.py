"""What an executed plan did."""


def join_rows(frame):
    """Run a frame; its rows, and the most rows that one of its joins put out."""
    rows, found = [tuple(r) for r in frame.collect()], []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return rows, max(found, default=0)


def largest_shares(frame):
    """Run a frame; of each of its shuffles of some size, the largest partition's share of the bytes."""
    frame.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleQueryStageExec" and node.mapStats().isDefined():
            sizes = list(node.mapStats().get().bytesByPartitionId())
            if len(sizes) > 1 and sum(sizes) > 20_000:
                found.append(max(sizes) / sum(sizes))
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return found
