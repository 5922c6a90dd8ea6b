"""Operations of a training-data pipeline, each a DataFrame -> DataFrame operator.

One module per operator; ``queries`` has the registered queries and ``oracles``
their DuckDB SQL. Nothing outside this subpackage imports it.
"""
