"""Weftline: incremental, explainable data pipelines expressed as Spark DataFrame plans."""
