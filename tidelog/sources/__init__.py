"""Where operations come from and go to: schemas, run files, and the store."""
