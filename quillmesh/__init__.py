"""quillmesh: entity resolution and corpus operators expressed as Spark plans."""
