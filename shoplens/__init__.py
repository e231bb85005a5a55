"""shoplens: retail analytics reports as Spark DataFrame pipelines."""
