"""Named queries; importing this package's modules fills the registry."""
