"""Where vectors come from: tables, generators, drift, duplicates, transforms; saved indexes."""
