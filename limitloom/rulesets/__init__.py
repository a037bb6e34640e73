"""The rule tables: statuses, bands, waterfalls and ladders as data plus one compiler."""
