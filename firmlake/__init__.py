"""firmlake: company-register data pipelines and search, expressed as Spark DataFrame plans."""
