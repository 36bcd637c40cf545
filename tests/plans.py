"""What a physical plan contains."""


def text(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def nodes(df, name: str) -> int:
    """How often an operator occurs in the tree part of the plan."""
    tree = text(df).split("\n\n")[0]
    return sum(1 for line in tree.splitlines() if name in line)
