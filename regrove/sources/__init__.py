"""Relations that a model can be fitted on."""
