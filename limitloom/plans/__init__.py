"""Ready pipelines composed from the operators."""
