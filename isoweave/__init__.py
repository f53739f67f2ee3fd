"""isoweave: consistency checking of engineering documents, expressed as Spark plans."""
