"""quillon: data-parallel analytics operators expressed as Spark DataFrame plans."""
