"""Scalar building blocks as SQL text, for `selectExpr`, `where` and `F.expr`.

Text instead of Column objects: one expression is one call into the JVM however long it is,
so building a wide plan stays cheap, and the same text reads naturally in `spark.sql`.
"""
