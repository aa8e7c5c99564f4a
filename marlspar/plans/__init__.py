"""Schema trees and row-group plans."""
