"""The driver's tables as a catalogue, and the registered queries over it."""
