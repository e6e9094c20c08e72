"""Statistics accumulated over streams."""
