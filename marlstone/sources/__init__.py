"""Tables that the operators read: files, snapshots of an inventory, vectors, pages."""
