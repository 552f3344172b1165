"""Small normalised frames from short table descriptions."""

KEY = "db_id bigint, schema_name string, table_name string"


def frames(spark, tables):
    """``tables``: name -> dict(cols, pk, unique, fks, incoming); columns are names or (name, type)."""
    rows, columns, constraints, fks = [], [], [], []
    for name, spec in tables.items():
        key = (1, "public", name)
        rows.append((*key, "BASE TABLE", spec.get("comment", ""), None))
        for n, col in enumerate(spec.get("cols", []), 1):
            col_name, kind = col if isinstance(col, tuple) else (col, "text")
            columns.append((*key, n, col_name, kind, False))
        if spec.get("pk"):
            constraints.append((*key, f"pk_{name}", "PRIMARY KEY", spec["pk"]))
        for n, cols in enumerate(spec.get("unique", [])):
            constraints.append((*key, f"uq_{name}_{n}", "UNIQUE", cols))
        for n, (cols, target) in enumerate(spec.get("fks", [])):
            fks.append((1, f"fk_{name}_{n}", "public", name, cols, "public", target, ["id"]))
        for n in range(spec.get("incoming", 0)):
            fks.append((1, f"in_{name}_{n}", "public", f"src{n}", ["x"], "public", name, ["id"]))
    index = spark.createDataFrame([], f"{KEY}, index_name string, is_unique boolean, columns array<string>")
    return {
        "tables": spark.createDataFrame(rows, f"{KEY}, table_type string, comment string, row_count_estimate bigint"),
        "columns": spark.createDataFrame(columns, f"{KEY}, ordinal_position int, column_name string, data_type string, nullable boolean"),
        "constraints": spark.createDataFrame(constraints, f"{KEY}, constraint_name string, constraint_type string, columns array<string>"),
        "indexes": index,
        "foreign_keys": spark.createDataFrame(
            fks,
            "db_id bigint, constraint_name string, from_schema string, from_table string, from_columns array<string>, "
            "to_schema string, to_table string, to_columns array<string>",
        ),
    }
